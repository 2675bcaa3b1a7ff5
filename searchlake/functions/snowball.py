"""Snowball stemmers of Romance languages, Finnish and Hungarian, from their published descriptions.

Suffixes are looked for longest first, within regions of the word: R1 after the first consonant
that follows a vowel, R2 the same within R1, RV by rules of the language.
"""

from __future__ import annotations

import re
from collections.abc import Iterable


def _after(word: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first consonant behind a vowel begins."""
    found = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return found.end() if found else len(word)


def _regions(word: str, vowels: str) -> tuple[int, int]:
    one = _after(word, vowels)
    return one, _after(word, vowels, one)


def _rv(word: str, vowels: str) -> int:
    """RV of Spanish and Italian."""
    if len(word) < 3:
        return len(word)
    if word[1] not in vowels:
        found = re.compile(f"[{vowels}]").search(word, 2)
    elif word[0] in vowels:
        found = re.compile(f"[^{vowels}]").search(word, 2)
    else:
        return 3
    return found.end() if found else len(word)


def _end(word: str, suffixes: Iterable[str], start: int = 0) -> str:
    """The longest of the suffixes that the word has at or behind start."""
    return max((s for s in suffixes if word.endswith(s) and len(word) - len(s) >= start), key=len, default="")


def _cut(word: str, r2: int, *before: str) -> str:
    """Without the first of these endings that lies in R2."""
    for s in before:
        if word.endswith(s):
            return word[: -len(s)] if len(word) - len(s) >= r2 else word
    return word


def _sets(**by: str) -> dict[str, str]:
    return {s: kind for kind, text in by.items() for s in text.split()}


def _romance(word: str, found: str, kind: str, r1: int, r2: int, swaps: dict[str, str], joined: str, before_ly: tuple[str, ...], before_mente: tuple[str, ...] = ()) -> str | None:
    """The shared part of the standard suffixes; None if nothing applies."""
    stem = word[: -len(found)]
    at = len(stem)
    if kind == "ly":
        if at < r1:
            return None
        if stem.endswith("iv"):
            own = _cut(stem, r2, "iv")
            return _cut(own, r2, "at") if own != stem else own
        return _cut(stem, r2, *before_ly)
    if at < r2:
        return None
    if kind == "plain":
        return stem
    if kind == "action":
        return _cut(stem, r2, joined)
    if kind == "mente":
        return _cut(stem, r2, *before_mente)
    if kind == "ity":
        return _cut(stem, r2, "abil", "ic", "iv")
    if kind == "ive":
        own = _cut(stem, r2, "at")
        return _cut(own, r2, "ic") if own != stem and swaps.get("ic") else own
    return stem + swaps[kind]


_ES = "aeiouáéíóúü"
_ES_STANDARD = _sets(
    plain="anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos",
    action="adora ador ación adoras adores aciones ante antes ancia ancias", log="logía logías", u="ución uciones", ente="encia encias", ly="amente", mente="mente", ity="idad idades", ive="iva ivo ivas ivos",
)
_ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_ES_FUTURE = [f"{v}{e}" for v in "aei" for e in "rían rías rán rás ríais ría réis ríamos remos rá ré".split()]
_ES_VERBS = _ES_FUTURE + "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos".split()
_PLAIN = str.maketrans("áéíóú", "aeiou")


def spanish(word: str) -> str:
    rv, (r1, r2) = _rv(word, _ES), _regions(word, _ES)
    pronoun = _end(word, _ES_PRONOUNS, rv)
    if pronoun:
        stem = word[: -len(pronoun)]
        if accented := _end(stem, ("iéndo", "ándo", "ár", "ér", "ír"), rv):
            word = stem[: -len(accented)] + accented.translate(_PLAIN)
        elif _end(stem, ("ando", "iendo", "ar", "er", "ir"), rv) or (_end(stem, ("yendo",), rv) and stem[:-5].endswith("u")):
            word = stem
    found, done = _end(word, _ES_STANDARD), None
    if found:
        done = _romance(word, found, _ES_STANDARD[found], r1, r2, {"log": "log", "u": "u", "ente": "ente"}, "ic", ("os", "ic", "ad"), ("ante", "able", "ible"))
    if done is not None:
        word = done
    else:
        y = _end(word, _ES_Y, rv)
        if y and word[: -len(y)].endswith("u"):
            word = word[: -len(y)]
        elif verb := _end(word, [*_ES_VERBS, "en", "es", "éis", "emos"], rv):
            word = word[: -len(verb)]
            if verb in ("en", "es", "éis", "emos") and word.endswith("gu"):
                word = word[:-1]
    last = _end(word, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv)
    if last:
        word = word[: -len(last)]
        if last in "eé" and word.endswith("gu") and len(word) > rv:
            word = word[:-1]
    return word.translate(_PLAIN)


_IT = "aeiouàèìòù"
_IT_STANDARD = _sets(
    plain="anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti",
    action="azione azioni atore atori", log="logia logie", u="uzione uzioni usione usioni", ente="enza enze", ment="amento amenti imento imenti", ly="amente", ity="ità", ive="ivo ivi iva ive",
)
_IT_PRONOUNS = "ci gli la le li lo mi ne si ti vi sene".split() + [a + b for a in ("glie", "me", "te", "ce", "ve") for b in ("la", "le", "li", "lo", "ne")]
_IT_VERBS = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo ere erono essero ete eva evamo evano evate evi evo Yamo iamo immo ire irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir".split()
    + [f"{v}{e}" for v in "ei" for e in "rà rai ranno rebbe rebbero rei remmo remo reste resti rete rò".split()]
)


def _inner(word: str, letters: str, vowels: str) -> str:
    """Letters between vowels as capitals, so they count as consonants."""
    out = list(word)
    for i in range(1, len(word) - 1):
        if word[i] in letters and out[i - 1] in vowels and word[i + 1] in vowels:
            out[i] = word[i].upper()
    return "".join(out)


def italian(word: str) -> str:
    word = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    word = _inner(word, "ui", _IT)
    rv, (r1, r2) = _rv(word, _IT), _regions(word, _IT)
    pronoun = _end(word, _IT_PRONOUNS, rv)
    if pronoun:
        stem = word[: -len(pronoun)]
        if _end(stem, ("ando", "endo"), rv):
            word = stem
        elif _end(stem, ("ar", "er", "ir"), rv):
            word = stem + "e"
    found, done = _end(word, _IT_STANDARD), None
    if found:
        if _IT_STANDARD[found] == "ment":
            done = word[: -len(found)] if len(word) - len(found) >= rv else None
        else:
            done = _romance(word, found, _IT_STANDARD[found], r1, r2, {"log": "log", "u": "u", "ente": "ente", "ic": "ic"}, "ic", ("os", "ic", "abil"))
    if done is not None:
        word = done
    elif verb := _end(word, _IT_VERBS, rv):
        word = word[: -len(verb)]
    if word and word[-1] in "aeioàèìò" and len(word) > rv:
        word = word[:-1]
        if word.endswith("i") and len(word) > rv:
            word = word[:-1]
    if word.endswith(("ch", "gh")) and len(word) > rv:
        word = word[:-1]
    return word.lower()


_FR = "aeiouyâàëéêèïîôûù"
_FR_STANDARD = _sets(
    plain="ance iqUe isme able iste eux ances iqUes ismes ables istes", action="atrice ateur ation atrices ateurs ations", log="logie logies", u="usion ution usions utions", ent="ence ences",
    ement="ement ements", ity="ité ités", ive="if ive ifs ives", eau="eaux", al="aux", euse="euse euses", issement="issement issements", ant="amment", emm="emment", ment="ment ments",
)
_FR_I = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def _french_standard(word: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """The word, and whether verb endings are still to be tried."""
    found = _end(word, _FR_STANDARD)
    if not found:
        return word, True
    kind, stem = _FR_STANDARD[found], word[: -len(found)]
    at = len(stem)

    def either(own: str, ending: str, other: str) -> str:
        return own[: -len(ending)] if len(own) - len(ending) >= r2 else own[: -len(ending)] + other

    if kind in ("plain", "log", "u", "ent") and at >= r2:
        return stem + {"plain": ""}.get(kind, kind), False
    if kind == "action" and at >= r2:
        return (either(stem, "ic", "iqU") if stem.endswith("ic") else stem), False
    if kind == "ement" and at >= rv:
        if stem.endswith("iv"):
            own = _cut(stem, r2, "iv")
            return (_cut(own, r2, "at") if own != stem else own), False
        if stem.endswith("eus"):
            return (stem[:-3] if at - 3 >= r2 else stem[:-3] + "eux" if at - 3 >= r1 else stem), False
        if stem.endswith(("abl", "iqU")):
            return _cut(stem, r2, "abl", "iqU"), False
        if stem.endswith(("ièr", "Ièr")) and at - 3 >= rv:
            return stem[:-3] + "i", False
        return stem, False
    if kind == "ity" and at >= r2:
        for ending, other in (("abil", "abl"), ("ic", "iqU")):
            if stem.endswith(ending):
                return either(stem, ending, other), False
        return _cut(stem, r2, "iv"), False
    if kind == "ive" and at >= r2:
        own = _cut(stem, r2, "at")
        return (either(own, "ic", "iqU") if own != stem and own.endswith("ic") else own), False
    if kind == "eau":
        return stem + "eau", False
    if kind == "al" and at >= r1:
        return stem + "al", False
    if kind == "euse" and at >= r1:
        return (stem if at >= r2 else stem + "eux"), False
    if kind == "issement" and at >= r1 and stem[-1:] not in _FR and stem:
        return stem, False
    if kind in ("ant", "emm") and at >= rv:
        return stem + ("ant" if kind == "ant" else "ent"), True
    if kind == "ment" and at - 1 >= rv and stem[-1] in _FR:
        return stem, True
    return word, True


def french(word: str) -> str:
    out = list(word)
    for i, c in enumerate(word):
        before, behind = out[i - 1] if i else "", word[i + 1] if i + 1 < len(word) else ""
        if (c == "u" and before == "q") or (c in "ui" and before and before in _FR and behind and behind in _FR) or (c == "y" and ((before and before in _FR) or (behind and behind in _FR))):
            out[i] = c.upper()
    word = "".join(out)
    if len(word) > 2 and (word[0] in _FR and word[1] in _FR or word.startswith(("par", "col", "tap"))):
        rv = 3
    else:
        first = re.compile(f"[{_FR}]").search(word, 1)
        rv = first.end() if first else len(word)
    r1, r2 = _regions(word, _FR)
    given = word
    word, verbs = _french_standard(word, rv, r1, r2)
    if verbs:
        start = word
        ending = _end(word, _FR_I, rv)
        if ending and len(word) - len(ending) - 1 >= rv and word[-len(ending) - 1] not in _FR:
            word = word[: -len(ending)]
        if word == start:
            ending = _end(word, [*_FR_E, *_FR_A, "ions"], rv)
            if ending == "ions":
                word = word[:-4] if len(word) - 4 >= r2 else word
            elif ending:
                word = word[: -len(ending)]
                if ending in _FR_A and word.endswith("e") and len(word) > rv:
                    word = word[:-1]
    if word != given:
        word = word[:-1] + {"Y": "i", "ç": "c"}.get(word[-1:], word[-1:])
    else:
        if word.endswith("s") and len(word) > 1 and word[-2] not in "aiouès":
            word = word[:-1]
        ending = _end(word, ("ion", "ier", "ière", "Ier", "Ière", "e"), rv)
        if ending == "ion":
            if len(word) - 3 >= r2 and len(word) - 4 >= rv and word[-4] in "st":
                word = word[:-3]
        elif ending:
            word = word[: -len(ending)] + ("" if ending == "e" else "i")
    if word.endswith(("enn", "onn", "ett", "ell", "eill")):
        word = word[:-1]
    word = re.sub(f"[éè]([^{_FR}]+)$", r"e\1", word)
    return word.lower()


_FI, _FI_LONG = "aeiouyäö", ("aa", "ee", "ii", "oo", "uu", "ää", "öö")


def _finnish_case(word: str, r1: int) -> str:
    found = _end(word, "han hen hin hon hän hön siin den tten seen a ä tta ttä ta tä ssa ssä sta stä lla llä lta ltä lle na nä ksi ine n".split(), r1)
    stem = word[: len(word) - len(found)]
    if not found:
        return word
    if found[0] == "h" and len(found) == 3:
        return stem if stem.endswith(found[1]) else word
    if found in ("siin", "den", "tten"):
        return stem if len(stem) > 1 and stem[-1] == "i" and stem[-2] in "aeiouäö" else word
    if found == "seen":
        return stem if stem.endswith(_FI_LONG) else word
    if found in ("a", "ä"):
        return stem if len(stem) > 1 and stem[-1] in _FI and stem[-2] not in _FI else word
    if found in ("tta", "ttä"):
        return stem if stem.endswith("e") else word
    if found == "n":
        return stem[:-1] if stem.endswith(("ie", *_FI_LONG)) else stem
    return stem


def finnish(word: str) -> str:
    r1, r2 = _regions(word, _FI)
    found = _end(word, "kin kaan kään ko kö han hän pa pä sti".split(), r1)
    if found:
        stem = word[: -len(found)]
        if (len(stem) >= r2) if found == "sti" else stem[-1:] in {*"nt", *_FI}:
            word = stem
    found = _end(word, "si ni nsa nsä mme nne an än en".split(), r1)
    if found:
        stem = word[: -len(found)]
        allowed = {"an": "ta ssa sta lla lta na", "än": "tä ssä stä llä ltä nä", "en": "lle ine"}.get(found)
        if found == "si":
            word = word if stem.endswith("k") else stem
        elif found == "ni":
            word = stem[:-3] + "ksi" if stem.endswith("kse") else stem
        elif allowed is None or stem.endswith(tuple(allowed.split())):
            word = stem
    case = _finnish_case(word, r1)
    removed, word = case != word, case
    found = _end(word, "mpi mpa mpä mmi mma mmä impi impa impä immi imma immä eja ejä".split(), r2)
    if found and not (len(found) == 3 and found[0] == "m" and word[: -len(found)].endswith("po")):
        word = word[: -len(found)]
    if removed:
        if word.endswith(("i", "j")) and len(word) > r1:
            word = word[:-1]
    elif word.endswith("t") and len(word) > r1 and len(word) > 1 and word[-2] in _FI:
        word = word[:-1]
        found = _end(word, ("mma", "imma"), r2)
        if found and not (found == "mma" and word[:-3].endswith("po")):
            word = word[: -len(found)]
    if len(word) > r1 and word.endswith(_FI_LONG) and len(word) - 2 >= r1:
        word = word[:-1]
    if len(word) - 2 >= r1 and word[-1:] in {*"aäei"} and word[-2] not in _FI:
        word = word[:-1]
    if len(word) - 2 >= r1 and word.endswith(("oj", "uj")):
        word = word[:-1]
    if len(word) - 2 >= r1 and word.endswith("jo"):
        word = word[:-1]
    return re.sub(f"([^{_FI}])\\1([{_FI}]*)$", r"\1\2", word)


_HU = "aáeéiíoóöőuúüű"
_HU_DOUBLE = ("bb", "cc", "ccs", "dd", "ff", "gg", "ggy", "jj", "kk", "ll", "lly", "mm", "nn", "nny", "pp", "rr", "ss", "ssz", "tt", "tty", "vv", "zz", "zzs")
_HU_STEPS = [
    ("ban ben ba be ra re nak nek val vel tól től ról ről ból ből hoz hez höz nál nél ig at et ot öt ért képp képpen kor ul ül vá vé onként enként anként ként en on an ön n t", "", "", True),
    ("", "án ánként", "én", False),
    ("astul estül stul stül", "ástul", "éstül", False),
    None,
    ("oké öké aké eké ké éi é", "áké áéi", "éké ééi éé", False),
    ("ünk unk nk juk jük uk ük em om am m od ed ad öd d ja je a e o", "ánk ájuk ám ád á", "énk éjük ém éd é", False),
    ("jaim jeim aim eim im jaid jeid aid eid id jai jei ai ei i jaink jeink eink aink ink jaitok jeitek aitok eitek itek jeik jaik aik eik ik", "áim áid ái áink áitok áik", "éim éid éi éink éitek éik", False),
    ("ök ok ek ak k", "ák", "ék", False),
]


def _undoubled(word: str, endings: tuple[str, ...], r1: int) -> str:
    found = _end(word, endings, r1)
    stem = word[: len(word) - len(found)]
    double = _end(stem, _HU_DOUBLE)
    return stem[: -len(double)] + double[1:] if found and double else word


def hungarian(word: str) -> str:
    if word[:1] and word[0] in _HU:
        first = re.compile(f"dzs|cs|gy|ly|ny|sz|ty|zs|[^{_HU}]").search(word, 1)
    else:
        first = re.compile(f"[{_HU}]").search(word)
    r1 = first.end() if first else len(word)
    word = _undoubled(word, ("al", "el"), r1)
    for step in _HU_STEPS:
        if step is None:
            word = _undoubled(word, ("á", "é"), r1)
            continue
        plain, to_a, to_e, open_ = step
        ends = {s: "" for s in plain.split()} | {s: "a" for s in to_a.split()} | {s: "e" for s in to_e.split()}
        found = _end(word, ends, r1)
        if found:
            word = word[: -len(found)] + ends[found]
            if open_ and word[-1:] in {"á", "é"}:
                word = word[:-1] + {"á": "a", "é": "e"}[word[-1]]
    return word
