"""Language components: stop words, normalisers and stemmers, and the analyzers made of them.

Stemmers follow the published algorithms (Porter, Snowball, the light stemmers of Savoy and
their kin), written as suffix tables. Snowball stemmers of Romance languages,
Finnish and Hungarian are in a module of their own. Languages whose stemmer isn't written yet
(Croatian, Polish, Romanian, Turkish) have their stop words only.
"""

from __future__ import annotations

import pkgutil
import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import replace
from functools import lru_cache

from searchlake.functions import snowball

Stemmer = Callable[[str], str]


@lru_cache
def _lists() -> dict[tuple[str, str], frozenset[str]]:
    found = {}
    for line in (pkgutil.get_data("searchlake.functions", "stopwords.txt") or b"").decode().splitlines():
        if line and not line.startswith("#"):
            head, words = line.split(": ", 1)
            kind, code = head.split()
            found[kind, code] = frozenset(words.split())
    return found


def stop_words(code: str) -> frozenset[str]:
    return _lists()["stop", code]


def token_maps() -> dict[str, frozenset[str]]:
    return {f"{kind}_{code}": words for (kind, code), words in _lists().items()}


def _plain(letters: str) -> Callable[[str], str]:
    """Base letters of the accented ones listed."""
    table = {ord(c): unicodedata.normalize("NFD", c)[0] for c in letters}
    return lambda s: s.translate(table)


# --- English ------------------------------------------------------------------------------


def possessive(s: str) -> str:
    return s[:-2] if len(s) >= 2 and s[-1] in "sS" and s[-2] in "'’＇" else s


_S_KEPT = frozenset("avalanches caches canoes cliches headaches heartaches moustaches mustaches oboes porsches quiches shoes tranches".split())


def english_plural(s: str) -> str:
    s = s.lower()
    if len(s) < 3 or s[-1] != "s" or s[-2] in "us":
        return s
    if s[-2] == "e":
        if len(s) > 4 and s[-3] == "i":
            return s[:-3] + "y"
        if any(s.endswith(k) for k in _S_KEPT):
            return s[:-1]
        if (len(s) > 4 and s[-3] == "x") or (len(s) > 3 and s[-3] == "o") or (len(s) > 4 and re.search("(?:[hs]|s[hs]|ch)es$", s) and s[-4] in "sc"):
            return s[:-2]
    return s[:-1]


def _is_vowel(s: str, i: int) -> bool:
    return s[i] in "aeiou" or (s[i] == "y" and i > 0 and not _is_vowel(s, i - 1))


def _m(s: str) -> int:
    form = "".join("v" if _is_vowel(s, i) else "c" for i in range(len(s)))
    return len(re.findall("v+c+", form))


def _has_vowel(s: str) -> bool:
    return any(_is_vowel(s, i) for i in range(len(s)))


def _double(s: str) -> bool:
    return len(s) > 1 and s[-1] == s[-2] and not _is_vowel(s, len(s) - 1)


def _cvc(s: str) -> bool:
    return len(s) > 2 and not _is_vowel(s, len(s) - 3) and _is_vowel(s, len(s) - 2) and not _is_vowel(s, len(s) - 1) and s[-1] not in "wxy"


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter(s: str) -> str:
    """Porter's stemmer (1980, with its author's later changes)."""
    if len(s) < 3 or not s.isascii():
        return s
    if s.endswith(("sses", "ies")):
        s = s[:-2]
    elif s.endswith("s") and not s.endswith("ss"):
        s = s[:-1]
    more = False
    if s.endswith("eed"):
        s = s[:-1] if _m(s[:-3]) > 0 else s
    elif s.endswith("ed") and _has_vowel(s[:-2]):
        s, more = s[:-2], True
    elif s.endswith("ing") and _has_vowel(s[:-3]):
        s, more = s[:-3], True
    if more:
        if s.endswith(("at", "bl", "iz")):
            s += "e"
        elif _double(s) and s[-1] not in "lsz":
            s = s[:-1]
        elif _m(s) == 1 and _cvc(s):
            s += "e"
    if s.endswith("y") and _has_vowel(s[:-1]):
        s = s[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in sorted(table, key=lambda p: -len(p[0])):
            if s.endswith(end):
                if _m(s[: -len(end)]) > 0:
                    s = s[: -len(end)] + new
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if s.endswith(end):
            stem = s[: -len(end)]
            if _m(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                s = stem
            break
    if s.endswith("e") and (_m(s[:-1]) > 1 or (_m(s[:-1]) == 1 and not _cvc(s[:-1]))):
        s = s[:-1]
    if s.endswith("ll") and _m(s[:-1]) > 1:
        s = s[:-1]
    return s


def _regions(s: str, vowels: str) -> tuple[int, int]:
    """Where the regions after the first and the second vowel-consonant begin."""
    m = re.search(f"[{vowels}][^{vowels}]", s)
    r1 = m.end() if m else len(s)
    m = re.compile(f"[{vowels}][^{vowels}]").search(s, r1)
    return r1, m.end() if m else len(s)


_ENGLISH_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_ENGLISH_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_E2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}


def _ends(s: str, table: Iterable[str]) -> str | None:
    """The longest ending of the table that s has."""
    return max((e for e in table if s.endswith(e)), key=len, default=None)


def english(s: str) -> str:
    """The Snowball English stemmer."""
    if len(s) < 3:
        return s
    s = s.replace("’", "'").lstrip("'")
    if s in _ENGLISH_WHOLE:
        return _ENGLISH_WHOLE[s]
    s = re.sub("(^|[aeiouy])y", r"\1Y", s)
    v = "aeiouy"
    m = re.match("gener|commun|arsen", s)
    r1 = m.end() if m else _regions(s, v)[0]
    m = re.compile(f"[{v}][^{v}]").search(s, r1)
    r2 = m.end() if m else len(s)

    def short_end(t: str) -> bool:
        return bool(re.search(f"[^{v}][{v}][^{v}wxY]$", t) or re.fullmatch(f"[{v}][^{v}]", t))

    s = re.sub("('s'|'s|')$", "", s)
    if s.endswith("sses"):
        s = s[:-2]
    elif s.endswith(("ied", "ies")):
        s = s[:-2] if len(s) > 4 else s[:-1]
    elif s.endswith("s") and not s.endswith(("us", "ss")) and re.search(f"[{v}].+s$", s):
        s = s[:-1]
    if s in _ENGLISH_KEPT:
        return s
    end = _ends(s, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(s) - len(end) >= r1:
            s = s[: -len(end)] + "ee"
    elif end and re.search(f"[{v}]", s[: -len(end)]):
        s = s[: -len(end)]
        if s.endswith(("at", "bl", "iz")):
            s += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", s):
            s = s[:-1]
        elif short_end(s) and r1 >= len(s):
            s += "e"
    if len(s) > 2 and s[-1] in "yY" and s[-2] not in v:
        s = s[:-1] + "i"
    end = _ends(s, [*_E2, "logi", "li"])
    if end and len(s) - len(end) >= r1:
        if end == "logi":
            s = s[:-1]
        elif end == "li":
            s = s[:-2] if s[-3:-2] and s[-3] in "cdeghkmnrt" else s
        else:
            s = s[: -len(end)] + _E2[end]
    table = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
    end = _ends(s, table)
    if end and len(s) - len(end) >= (r2 if end == "ative" else r1):
        s = s[: -len(end)] + table[end]
    end = _ends(s, ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"))
    if end and len(s) - len(end) >= r2 and (end != "ion" or s[-4:-3] in ("s", "t")):
        s = s[: -len(end)]
    if s.endswith("e") and (len(s) - 1 >= r2 or (len(s) - 1 >= r1 and not short_end(s[:-1]))):
        s = s[:-1]
    elif s.endswith("ll") and len(s) - 1 >= r2:
        s = s[:-1]
    return s.replace("Y", "y")


# --- German -------------------------------------------------------------------------------


def normalize_de(s: str) -> str:
    out, state = [], "n"
    for c in s:
        if c in "ao":
            state = "u"
        elif c == "u":
            state = "u" if state == "n" else "v"
        elif c == "e":
            if state == "u":
                state = "v"
                continue
            state = "v"
        elif c in "iqyäöü":
            state, c = "v", {"ä": "a", "ö": "o", "ü": "u"}.get(c, c)
        else:
            state, c = "n", "ss" if c == "ß" else c
        out.append(c)
    return "".join(out)


_de_plain = _plain("äàáâöòóôïìíîüùúû")


def german_light(s: str) -> str:
    s = _de_plain(s)
    for rules in ((("ern", "", 5), ("e[mnrs]", "", 4), ("e", "", 3), ("(?<=[bdfghklmnt])s", "", 3)), (("est", "", 5), ("e[rn]", "", 4), ("(?<=[bdfghklmnt])st", "", 4))):
        for end, new, longer in rules:
            if len(s) > longer and re.search(f"{end}$", s):
                s = re.sub(f"{end}$", new, s)
                break
    return s


def german(s: str) -> str:
    """The Snowball German stemmer."""
    v = "aeiouyäöü"
    s = re.sub(f"(?<=[{v}])([uy])(?=[{v}])", lambda m: m[0].upper(), s.replace("ß", "ss"))
    r1, r2 = _regions(s, v)
    r1 = max(r1, 3)
    end = _ends(s, ("em", "ern", "er", "e", "en", "es"))
    if end is None and re.search("[bdfghklmnrt]s$", s):
        end = "s"
    if end and len(s) - len(end) >= r1:
        s = s[: -len(end)]
        if end in ("e", "en", "es") and s.endswith("niss"):
            s = s[:-1]
    end = _ends(s, ("en", "er", "est"))
    if end is None and re.search(".{3}[bdfghklmnt]st$", s):
        end = "st"
    if end and len(s) - len(end) >= r1:
        s = s[: -len(end)]
    end = _ends(s, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if end and len(s) - len(end) >= r2:
        rest = s[: -len(end)]
        if end in ("end", "ung"):
            s = rest
            if s.endswith("ig") and not s.endswith("eig") and len(s) - 2 >= r2:
                s = s[:-2]
        elif end in ("ig", "ik", "isch"):
            s = s if rest.endswith("e") else rest
        elif end in ("lich", "heit"):
            s = rest
            if s.endswith(("er", "en")) and len(s) - 2 >= r1:
                s = s[:-2]
        else:
            s = rest
            more = _ends(s, ("lich", "ig"))
            if more and len(s) - len(more) >= r2:
                s = s[: -len(more)]
    return _plain("äöü")(s.replace("U", "u").replace("Y", "y"))


# --- Dutch --------------------------------------------------------------------------------

_NL_V = "aeiouyè"


def dutch(s: str) -> str:
    """The Snowball Dutch stemmer."""
    s = _plain("äëïöüáéíóú")(s)
    s = re.sub(f"(^|[{_NL_V}])y", r"\1Y", s)
    s = re.sub(f"(?<=[{_NL_V}])i(?=[{_NL_V}])", "I", s)
    r1, r2 = _regions(s, _NL_V)
    r1 = max(r1, 3)

    def undouble(t: str) -> str:
        return t[:-1] if t.endswith(("kk", "dd", "tt")) else t

    def drop_en(t: str, end: str) -> str:
        rest = t[: -len(end)]
        return undouble(rest) if len(rest) >= r1 and rest and rest[-1] not in _NL_V and not rest.endswith("gem") else t

    def drop_e(t: str) -> tuple[str, bool]:
        fits = t.endswith("e") and len(t) - 1 >= r1 and len(t) > 1 and t[-2] not in _NL_V
        return (undouble(t[:-1]), True) if fits else (t, False)

    end = _ends(s, ("heden", "en", "ene", "s", "se"))
    if end == "heden" and len(s) - 5 >= r1:
        s = s[:-5] + "heid"
    elif end in ("en", "ene"):
        s = drop_en(s, end)
    elif end in ("s", "se"):
        rest = s[: -len(end)]
        s = rest if len(rest) >= r1 and rest and rest[-1] not in _NL_V + "j" else s
    s, dropped = drop_e(s)
    if s.endswith("heid") and len(s) - 4 >= r2 and s[-5:-4] != "c":
        s = s[:-4]
        if s.endswith("en"):
            s = drop_en(s, "en")
    end = _ends(s, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if end and len(s) - len(end) >= r2:
        rest = s[: -len(end)]
        if end in ("end", "ing"):
            s = rest[:-2] if rest.endswith("ig") and len(rest) - 2 >= r2 and rest[-3:-2] != "e" else undouble(rest)
        elif end == "ig":
            s = rest if not rest.endswith("e") else s
        elif end == "lijk":
            s = drop_e(rest)[0]
        elif end == "baar" or dropped:
            s = rest
    s = re.sub(f"(?<=[^{_NL_V}])(a|e|o|u)\\1(?=[^{_NL_V}I]$)", r"\1", s)
    return s.replace("Y", "y").replace("I", "i")


# --- Romance languages --------------------------------------------------------------------

normalize_es = _plain("àáâäòóôöèéêëùúûüìíîï")


def spanish_light(s: str) -> str:
    if len(s) < 5:
        return s
    if s[-1] in "oae":
        return s[:-1]
    for end, cut, new in (("eses", 2, ""), ("ces", 3, "z"), ("os", 2, ""), ("as", 2, ""), ("es", 2, "")):
        if s.endswith(end):
            return s[:-cut] + new
    return s


_it_plain = _plain("àáâäòóôöèéêëùúûüìíîï")


def italian_light(s: str) -> str:
    if len(s) < 6:
        return s
    s = _it_plain(s)
    return re.sub("(?:[ih]e|[hi]i|ia|io|[eiao])$", "", s)


_PT_SUFFIXES = [(4, "(?<=[rslz])es", ""), (3, "ns", "m"), (4, "[eé]is", "el"), (4, "ais", "al"), (4, "óis", "ol"), (4, "is", "il"), (3, "[õã]es", "ão"), (6, "mente", ""), (3, "s", "")]
_PT_FEMININE = [(7, "(inh|iac|eir)a", r"\1o"), (6, "(os|ic|id|ad|iv|am)a", r"\1o"), (6, "ona", "ão"), (6, "ora", "or"), (6, "esa", "ês"), (6, "na", "no")]
_pt_plain = _plain("àáâäãòóôöõèéêëùúûüìíîïç")


def _first_rule(s: str, rules: list[tuple[int, str, str]]) -> str:
    for longer, end, new in rules:
        if len(s) > longer and re.search(f"{end}$", s):
            return re.sub(f"{end}$", new, s)
    return s


def portuguese_light(s: str) -> str:
    if len(s) < 4:
        return s
    s = _first_rule(s, _PT_SUFFIXES)
    if len(s) > 3 and s[-1] == "a":
        s = _first_rule(s, _PT_FEMININE)
    if len(s) > 4 and s[-1] in "eao":
        s = s[:-1]
    return _pt_plain(s)


_fr_plain = _plain("àáâôèéêùûîç")


def _fr_norm(s: str) -> str:
    if len(s) > 4:
        s = re.sub(r"([^\W\d_])\1+", r"\1", _fr_plain(s))
    if len(s) > 4 and s.endswith("ie"):
        s = s[:-2]
    if len(s) > 4:
        s = re.sub("r$", "", s)
        s = re.sub("e$", "", s)
        s = re.sub("e$", "", s)
        s = re.sub(r"([^\W\d_])\1$", r"\1", s)
    return s


#: (longer than, ending, what replaces it, whether that ends the stemming)
_FR_RULES = [
    (9, "issement", "ir", True), (8, "issant", "ir", True), (6, "ement", None, True), (11, "ficatrice", "fier", True),
    (10, "ficateur", "fier", True), (9, "catrice", "quer", True), (8, "cateur", "quer", True), (8, "atrice", "er", True),
    (7, "ateur", "er", True), (6, "trice", "teur", False), (5, "ième", "", True), (7, "teuse", "ter", True), (6, "teur", "ter", True),
    (5, "euse", "eu", True), (8, "ère", "er", True), (7, "ive", "if", True), (4, "folle", "fou", True), (4, "molle", "mou", True),
    (9, "nnelle", "n", True), (9, "nnel", "n", True), (4, "ète", "et", False), (8, "ique", "", False), (8, "esse", "e", True),
    (7, "inage", "in", True), (9, "isation", "", True), (9, "isateur", "", True), (8, "ation", "", True), (8, "ition", "", True),
]


def french_light(s: str) -> str:
    if len(s) > 5 and s[-1] == "x":
        s = s[:-2] + "l" if s[-3:-1] == "au" and s[-4] != "e" else s[:-1]
    if len(s) > 3 and s[-1] == "x":
        s = s[:-1]
    if len(s) > 3 and s[-1] == "s":
        s = s[:-1]
    for longer, end, new, last in _FR_RULES:
        if len(s) > longer and s.endswith(end):
            if new is None:  # -ement leaves its first e, and -iv(e) becomes -if
                s = s[:-4]
                s = s[:-2] + "f" if len(s) > 3 and s.endswith("ive") else s
            else:
                s = s[: -len(end)] + new
            if end == "isation" and len(s) > 5 and s.endswith("ual"):
                s = s[:-2] + "el"
            if last:
                break
    return _fr_norm(s)


def french_minimal(s: str) -> str:
    if len(s) < 6:
        return s
    if s[-1] == "x":
        return s[:-2] + "l" if s[-3:-1] == "au" else s[:-1]
    for c in "sreé":
        if s[-1] == c:
            s = s[:-1]
    return s[:-1] if s[-1] == s[-2] else s


# --- Scandinavian languages and Russian ---------------------------------------------------


def _scandinavian(vowels: str, first: Iterable[str], s_before: str, second: tuple[str, ...], third: dict[str, str], also: Callable[[str, int], str] = lambda s, r: s) -> Stemmer:
    def stem(s: str) -> str:
        m = re.search(f"[{vowels}][^{vowels}]", s)
        r1 = max(m.end(), 3) if m else len(s)
        end = _ends(s[r1:], [*first, "s"])
        if end == "s":
            s = s[:-1] if re.search(f"(?:{s_before})s$", s) else s
        elif end:
            s = s[: -len(end)] + ("er" if end in ("erte", "ert") and "erte" in first and "hetene" in first else "")
        if s[r1:].endswith(second):
            s = s[:-1]
        end = _ends(s[r1:], third)
        if end:
            s = s[: -len(end)] + third[end]
        return also(s, r1)

    return stem


swedish = _scandinavian("aeiouyäåö", "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split(), "[bcdfghjklmnoprtvy]", ("dd", "gd", "nn", "dt", "gt", "kt", "tt"), {"lig": "", "ig": "", "els": "", "löst": "lös", "fullt": "full"})
norwegian = _scandinavian("aeiouyæåø", "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast erte ert".split(), "[bcdfghjlmnoprtvyz]|[^aeiouyæåø]k", ("dt", "vt"), {"leg": "", "eleg": "", "ig": "", "eig": "", "lig": "", "elig": "", "els": "", "lov": "", "elov": "", "slov": "", "hetslov": ""})


def danish(s: str) -> str:
    """The Snowball Danish stemmer."""
    m = re.search("[aeiouyæåø][^aeiouyæåø]", s)
    r1 = max(m.end(), 3) if m else len(s)

    def pair(t: str) -> str:
        return t[:-1] if t[r1:].endswith(("gd", "dt", "gt", "kt")) else t

    end = _ends(s[r1:], "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret s".split())
    if end == "s":
        s = s[:-1] if re.search("[abcdfghjklmnoprtvyzå]s$", s) else s
    elif end:
        s = s[: -len(end)]
    s = pair(s)
    if s.endswith("igst"):
        s = s[:-2]
    end = _ends(s[r1:], ("ig", "lig", "elig", "els", "løst"))
    if end == "løst":
        s = s[:-1]
    elif end:
        s = pair(s[: -len(end)])
    if len(s) > r1 and re.search(r"([^aeiouyæåø])\1$", s):
        s = s[:-1]
    return s


_RU_V = "аеиоуыэюя"
_RU_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_RU_VERB1, _RU_VERB2 = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
_RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def russian(s: str) -> str:
    """The Snowball Russian stemmer."""
    s = s.replace("ё", "е")
    m = re.search(f"[{_RU_V}]", s)
    if not m:
        return s
    rv = m.end()
    _, r2 = _regions(s, _RU_V)

    def after_a(t: str, table: list[str]) -> str | None:
        end = _ends(t[rv:], table)
        return end if end and len(t) - len(end) - 1 >= rv and t[-len(end) - 1] in "ая" else None

    end = _ends(s[rv:], ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись")) or after_a(s, ["в", "вши", "вшись"])
    if end:
        s = s[: -len(end)]
    else:
        end = _ends(s[rv:], ("ся", "сь"))
        s = s[: -len(end)] if end else s
        end = _ends(s[rv:], _RU_ADJECTIVE)
        if end:
            s = s[: -len(end)]
            end = _ends(s[rv:], ("ивш", "ывш", "ующ")) or after_a(s, ["ем", "нн", "вш", "ющ", "щ"])
            s = s[: -len(end)] if end else s
        else:
            a, b = after_a(s, _RU_VERB1), _ends(s[rv:], _RU_VERB2)
            end = max((x for x in (a, b) if x), key=len, default=None) or _ends(s[rv:], _RU_NOUN)
            s = s[: -len(end)] if end else s
    if s[rv:].endswith("и"):
        s = s[:-1]
    end = _ends(s[r2:], ("ост", "ость"))
    s = s[: -len(end)] if end else s
    if s.endswith("нн"):
        s = s[:-1]
    else:
        end = _ends(s[rv:], ("ейш", "ейше"))
        if end:
            s = s[: -len(end)]
            s = s[:-1] if s.endswith("нн") else s
        elif s[rv:].endswith("ь"):
            s = s[:-1]
    return s


# --- Arabic script, Hindi, Chinese-Japanese-Korean ----------------------------------------

_AR_MAP = {ord(a): b for a, b in zip("آأإىة", "اااي" + "ه", strict=True)} | {c: None for c in (0x640, *range(0x64B, 0x653))}
_FA_MAP = {0x6CC: "ي", 0x6D2: "ي", 0x6A9: "ك", 0x6C0: "ه", 0x6C1: "ه", 0x654: None}


def normalize_ar(s: str) -> str:
    return s.translate(_AR_MAP)


def normalize_fa(s: str) -> str:
    return s.translate(_FA_MAP)


def arabic(s: str) -> str:
    for p in ("ال", "وال", "بال", "كال", "فال", "لل", "و"):
        if s.startswith(p) and len(s) - len(p) >= (3 if len(p) == 1 else 2):
            s = s[len(p) :]
            break
    for e in ("ها", "ان", "ات", "ون", "ين", "يه", "ية", "ه", "ة", "ي"):
        if s.endswith(e) and len(s) - len(e) >= 2:
            s = s[: -len(e)]
    return s


def normalize_ckb(s: str) -> str:
    s = s.translate({0x64A: "ی", 0x649: "ی", 0x643: "ک"} | {c: None for c in (0x640, *range(0x64B, 0x653))})
    s = re.sub("ه?‌", lambda m: "ە" if m[0][0] == "ه" else "", s)
    s = re.sub("ه$", "ە", s)
    s = s.replace("ة", "ە").replace("ھ", "ه").replace("ڒ", "ڕ")
    s = "".join(c for c in s if unicodedata.category(c) != "Cf")
    return "ڕ" + s[1:] if s.startswith("ر") else s


_CKB = [(6, "ێکی", 3), (7, "یەکی", 4), (5, "ێک", 2), (6, "یەک", 3), (6, "ەکە", 3), (5, "کە", 2), (7, "ەکان", 4), (6, "کان", 3), (7, "یانی", 4), (6, "انی", 3), (6, "یان", 3), (5, "ان", 2), (7, "یانە", 4), (6, "انە", 3), (5, "ایە", 2), (5, "ەیە", 2), (4, "ە", 1), (4, "ی", 1)]


def sorani(s: str) -> str:
    for longer, end, cut in ((5, "دا", 2), (4, "نا", 1), (6, "ەوە", 3)):
        if len(s) > longer and s.endswith(end):
            s = s[:-cut]
            break
    if len(s) > 6 and s.endswith(("مان", "یان", "تان")):
        s = s[:-3]
    for longer, end, cut in _CKB:
        if len(s) > longer and s.endswith(end):
            return s[:-cut]
    return s


_HI_PAIRS = "ँं ऩन ऱर ऴळ क़क ख़ख ग़ग ज़ज ड़ड ढ़ढ फ़फ य़य ॅे ॆे ॉो ॊो ऍए ऎए ऑओ ऒओ ॲअ आअ ईइ ऊउ ॠऋ ॡऌ ऐए औओ ीि ूु ॄृ ॣॢ ैे ौो"
_HI_MAP = {ord(p[0]): p[1] for p in _HI_PAIRS.split() if len(p) == 2} | {0x93C: None, 0x200D: None, 0x200C: None, 0x94D: None}
_HI_MAP |= {0x958 + i: c for i, c in enumerate("कखगजडढफय")} | {0x929: "न", 0x931: "र", 0x934: "ळ"}
_HI_ENDS = {5: "ाएंगी ाएंगे ाऊंगी ाऊंगा ाइयाँ ाइयों ाइयां", 4: "ाएगी ाएगा ाओगी ाओगे एंगी ेंगी एंगे ेंगे ूंगी ूंगा ातीं नाओं नाएं ताओं ताएं ियाँ ियों ियां", 3: "ाकर ाइए ाईं ाया ेगी ेगा ोगी ोगे ाने ाना ाते ाती ाता तीं ाओं ाएं ुओं ुएं ुआं", 2: "कर ाओ िए ाई ाए ने नी ना ते ीं ती ता ाँ ां ों ें", 1: "ो े ू ु ी ि ा"}


def normalize_hi(s: str) -> str:
    return s.replace("न्", "ं").translate(_HI_MAP)


#: Sequences by offset in a script's block, and the scripts' first letters: devanagari and gujarati.
_IN_SEQUENCES = {
    0x900: "053E45:11 053E46:12 053E47:13 053E48:14 053E:06 0545:72 0546:04 0549:11 054A:12 054B:13 054C:14 0645:11 0646:12 0647:13 0648:14 0941:0A 0F45:0D 0F46:0E 0F47:10",
    0xA80: "053E45:11 053E47:13 053E48:14 053E:06 0545:0D 0547:0F 0548:10 0549:11 054B:13 054C:14 0645:11 0647:13 0648:14",
}


@lru_cache
def _in_letters() -> dict[str, str]:
    found = {"\u09a4\u09cd\u200d": "\u09ce"}
    for base, text in _IN_SEQUENCES.items():
        for rule in text.split():
            old, new = rule.split(":")
            found["".join(chr(base + int(old[i : i + 2], 16)) for i in range(0, len(old), 2))] = chr(base + int(new, 16))
    return found


def normalize_in(s: str) -> str:
    """Indic letters written as sequences become one letter where Unicode has it."""
    letters = _in_letters()
    found = re.sub("|".join(sorted(map(re.escape, letters), key=len, reverse=True)), lambda m: letters[m[0]], s)
    return unicodedata.normalize("NFC", found)


def hindi(s: str) -> str:
    for n, ends in _HI_ENDS.items():
        if len(s) > n + 1 and s.endswith(tuple(ends.split())):
            return s[:-n]
    return s


def cjk_width(s: str) -> str:
    """Full-width ASCII and half-width Katakana by their usual forms."""
    wide = "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in s)
    return re.sub("[･-ﾟ]+", lambda m: unicodedata.normalize("NFKC", m[0]), wide)


def cjk_bigram(unigrams: bool = False):
    """Adjacent ideographs as pairs; lone ones as they are; other tokens pass."""

    def pairs(tokens):
        out, run, pos = [], [], 1

        def flush():
            nonlocal run, pos
            for i, t in enumerate(run):
                if len(run) == 1 or unigrams:
                    out.append(replace(t, pos=pos, type="single"))
                if i + 1 < len(run):
                    out.append(replace(t, term=t.term + run[i + 1].term, end=run[i + 1].end, pos=pos, type="double"))
                    pos += 1
                elif len(run) == 1 or unigrams:
                    pos += len(run) == 1
            run = []

        for t in tokens:
            if t.type != "ideographic":
                flush()
                out.append(replace(t, pos=pos))
                pos += 1
                continue
            at = t.start
            for c in t.term:
                one = replace(t, term=c, start=at, end=at + len(c.encode()))
                if run and run[-1].end != one.start:
                    flush()
                run.append(one)
                at = one.end
        flush()
        return out

    return pairs


# --- registration -------------------------------------------------------------------------

SNOWBALL: dict[str, Stemmer] = {"english": english, "porter": porter, "german": german, "swedish": swedish, "norwegian": norwegian, "danish": danish, "russian": russian, "dutch": dutch, "spanish": snowball.spanish, "french": snowball.french, "italian": snowball.italian, "finnish": snowball.finnish, "hungarian": snowball.hungarian}
STEMMERS: dict[str, Stemmer] = {
    "stemmer_porter": porter, "stemmer_en_snowball": english, "stemmer_en_plural": english_plural, "stemmer_de_light": german_light,
    "stemmer_de_snowball": german, "stemmer_es_light": spanish_light, "stemmer_it_light": italian_light, "stemmer_fr_light": french_light,
    "stemmer_fr_min": french_minimal, "stemmer_pt_light": portuguese_light, "stemmer_sv_snowball": swedish, "stemmer_no_snowball": norwegian,
    "stemmer_da_snowball": danish, "stemmer_ru_snowball": russian, "stemmer_ar": arabic, "stemmer_ckb": sorani, "stemmer_hi": hindi, "stemmer_nl_snowball": dutch,
    "stemmer_es_snowball": snowball.spanish, "stemmer_fr_snowball": snowball.french, "stemmer_it_snowball": snowball.italian, "stemmer_fi_snowball": snowball.finnish, "stemmer_hu_snowball": snowball.hungarian,
}
NORMALIZERS = {"normalize_de": normalize_de, "normalize_es": normalize_es, "normalize_ar": normalize_ar, "normalize_fa": normalize_fa, "normalize_ckb": normalize_ckb, "normalize_hi": normalize_hi, "normalize_in": normalize_in, "possessive_en": possessive, "cjk_width": cjk_width}

_LOWER = "to_lower"
CHAINS: dict[str, tuple[tuple[str, ...], str, tuple[str, ...]]] = {
    "en": ((), "unicode", ("possessive_en", _LOWER, "stop_en", "stemmer_porter")),
    "de": ((), "unicode", (_LOWER, "stop_de", "normalize_de", "stemmer_de_light")),
    "es": ((), "unicode", (_LOWER, "stop_es", "normalize_es", "stemmer_es_light")),
    "fr": ((), "unicode", (_LOWER, "elision_fr", "stop_fr", "stemmer_fr_light")),
    "it": ((), "unicode", (_LOWER, "elision_it", "stop_it", "stemmer_it_light")),
    "pt": ((), "unicode", (_LOWER, "stop_pt", "stemmer_pt_light")),
    "nl": ((), "unicode", (_LOWER, "stop_nl", "stemmer_nl_snowball")),
    "sv": ((), "unicode", (_LOWER, "stop_sv", "stemmer_sv_snowball")),
    "no": ((), "unicode", (_LOWER, "stop_no", "stemmer_no_snowball")),
    "da": ((), "unicode", (_LOWER, "stop_da", "stemmer_da_snowball")),
    "ru": ((), "unicode", (_LOWER, "stop_ru", "stemmer_ru_snowball")),
    "ar": ((), "unicode", (_LOWER, "normalize_nfkc", "stop_ar", "normalize_ar", "stemmer_ar")),
    "fa": (("zero_width_spaces",), "unicode", (_LOWER, "normalize_ar", "normalize_fa", "stop_fa")),
    "ckb": ((), "unicode", ("normalize_ckb", _LOWER, "stop_ckb", "stemmer_ckb")),
    "hi": ((), "unicode", (_LOWER, "normalize_in", "normalize_hi", "stop_hi", "stemmer_hi")),
    "fi": ((), "unicode", (_LOWER, "stop_fi", "stemmer_fi_snowball")),
    "hu": ((), "unicode", (_LOWER, "stop_hu", "stemmer_hu_snowball")),
    "cjk": ((), "unicode", ("cjk_width", _LOWER, "cjk_bigram")),
}


def token_filters() -> dict[str, Callable]:
    from searchlake.functions import analysis as a

    found: dict[str, Callable] = {f"stop_{code}": a.stop_filter(words) for (kind, code), words in _lists().items() if kind == "stop"}
    found |= {f"elision_{code}": a.elision_filter(words) for (kind, code), words in _lists().items() if kind == "articles"}
    found |= {name: a.stemmer_filter(stem) for name, stem in STEMMERS.items()}
    found |= {name: a._mapped(change) for name, change in NORMALIZERS.items()}
    return found | {"cjk_bigram": cjk_bigram(), "normalize_nfkc": a.normalize_filter("nfkc")}
