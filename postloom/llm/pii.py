"""Personal information inside free text by a semi-Markov conditional random field.

Candidate segments of bounded length are proposed for five kinds, with competing ends and kinds; whole-span features (the form of
the segment, its letter case, words that are names, cues left and right of it) and features of neighbouring segments score them with
trained weights. Dynamic programming over the candidates, ordered by their ends, chooses boundaries and kinds jointly; text
between segments scores nothing. Weights are fitted by ``pii_training`` and lie beside this module.

A name candidate is any run of two to five capitalised words, initials and particles without a common word, and, right behind a cue
such as a title or a closing, or right before an address or number, a run of words in any case. The list of usual names is one
feature among others.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
WEIGHTS = Path(__file__).with_name("pii_weights.json")

# Usual given and family names of several countries, particles.
GIVEN = """james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen
daniel lisa matthew nancy anthony mark paul andrew emily kevin laura brian anna peter maria george hannah oliver emma jack sophie
hans klaus karl jürgen wolfgang stefan andreas sabine petra monika ursula heike birgit lukas jonas lena anja uwe dieter
jean pierre michel andré philippe marie nathalie isabelle sylvie camille julien nicolas amélie chloé céline françois
juan carlos josé luis miguel antonio manuel ana carmen elena lucía sofía pilar javier diego ines nuno
giovanni giulia marco francesca anders lars ingrid astrid olga ivan dmitri natalia piotr agnieszka wei li mei hiroshi yuki kenji omar fatima ahmed aisha
amadou kwame rahul anil deepa""".split()
FAMILY = """smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson thomas taylor moore jackson martin
lee thompson white harris clark lewis robinson walker young king wright scott hill green adams nelson baker hall campbell mitchell roberts carter evans
müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann koch bauer richter klein wolf schröder neumann schwarz zimmermann
bernard dubois durand moreau laurent lefebvre leroy roux fournier girard bonnet lambert rousseau
garcía martínez lópez sánchez pérez gómez fernández díaz moreno muñoz álvarez romero navarro torres
rossi russo ferrari kowalski nowak novak jensen hansen nielsen larsen andersson ivanov petrov chen wang zhang tanaka suzuki sato kim park singh patel khan ali""".split()
PARTICLES = "van der den de la le von zu di del du da dos".split()
STREETS = "st street ave avenue blvd boulevard rd road ln lane dr drive court ct crescent terrace way square close".split()
CUES = {
    "phone": "call text tel phone telephone whatsapp voicemail mobile ring fax unter llamen appelez llame anrufen sms dial back au al telefon teléfono reach".split(),
    "id": "ssn passport identity national_id ausweisnummer ausweis identidad dni nino nir identité identite d'identité leaked echoed mine".split(),
    "machine": "serial build checksum code order ticket trace error job version release port rows row sha hash commit id".split(),
    "address": "address moved sent disk shipped dongle street parcel ging factura fue out office home lives live adresse dirección livré domicile wohnt".split(),
}
_CUE_OF: dict[str, list[str]] = {}
for _kind, _words in CUES.items():
    for _w in _words:
        _CUE_OF.setdefault(_w, []).append(_kind)
_GIVEN, _FAMILY, _PARTICLES = set(GIVEN), set(FAMILY), set(PARTICLES)
_NAMES = _GIVEN | _FAMILY
_ORG = set("inc ltd llc labs systems software group studio tools hosting works analytics gmbh corp company cloud data server loader cache networks partners storage team support sales desk db sql".split())

# Frequent words of four languages; none of them is part of a name.
COMMON = set("""a about after again all also am an and any are as at back be because been before being but by can could day did do does down each even every few first
for from get give go good has have he help her here him his how i if in into is it its just know last like look make many me more most much my need never new
no not now of off on once one only or other our out over own please rather really see send she should since so some still such take than that the their them then there these
they thing this those through time to too two under until up us use very was way we well were what when where which while who why will with would year you your
auf aus bei bin bis das dass dem den der des die doch ein eine einem einen einer er es für hat ich im in ist ja kein mit nach nicht noch nur oder schon sich sie sind
un une des les est et il elle nous vous qui que dans pour pas sur avec ce cette el los las una y con por para no se su como pero más muy ya call mail ring reach contact tell write thanks hello dear""".split()) - set(PARTICLES) | {"the"}

_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_LEFT = re.compile(r"[\w'’]+")
_EMAIL = re.compile(r"[\w.+%'-]*\w[+]?\s?(?:@|＠|[(\[{]\s?at\s?[)\]}])\s?[\w-]+(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?)[\w-]+)*|[\w.+%'-]*\w\sat\s[\w-]+(?:\sdot\s[\w-]+)+", re.I)
_NUMBER = re.compile(r"[+(\d](?<![\w.,@#/=-].)(?:(?<=[+(])\(?\d)?[\d\s().\-/]{5,24}\d(?:\s?(?:ext\.?|x|app\.?)\s?\d{1,5})?(?![\w@-])", re.I)
_LOOSE = re.compile(r"(?<=[=;\"“])\+?\(?\d[\d ().\-/]{5,24}\d(?![\w@-])")
_PHONE_FORMS = [
    ("intl", re.compile(r"(?:\+|00)\(?\d{1,3}\)?(?:[ .\-/()]*\d){7,12}(?:\s?(?:ext\.?|x|app\.?)\s?\d{1,5})?", re.I)),
    ("nanp", re.compile(r"(?:1[ .-])?(?:\(\d{3}\)\s?|\d{3}[ .-])\d{3}[ .-]\d{4}(?:\s?(?:ext\.?|x)\s?\d{1,5})?", re.I)),
    ("pairs", re.compile(r"0\d(?:[ .-]\d\d){4}")),
    ("area", re.compile(r"\(?0\d{1,4}\)?[ /-]\d{3,6}(?:[ -]\d{2,6})?")),
    ("bare", re.compile(r"0?\d{7,11}")),
]
_ID = re.compile(r"\b(?<![.@#/-])(?:[A-Za-z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-Da-d]|\d{3}[- ]\d\d[- ]\d{4}|[12] \d\d \d\d \d\d \d{3} \d{3}(?: \d\d)?|\d{8}[A-Za-z]|[A-Za-z]\d{7,8}[A-Za-z]?|\d{9,15})(?![\w@-])")
_ID_FORMS = [
    ("letters6", re.compile(r"[A-Za-z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-Da-d]")),
    ("3-2-4", re.compile(r"\d{3}[- ]\d\d[- ]\d{4}")),
    ("1-2-2-2-3-3", re.compile(r"[12] \d\d \d\d \d\d \d{3} \d{3}(?: \d\d)?")),
    ("8letter", re.compile(r"\d{8}[A-Za-z]")),
    ("letter8", re.compile(r"[A-Za-z]\d{7,8}[A-Za-z]?")),
    ("bare", re.compile(r"\d{9,15}")),
]
_SUFFIX = re.compile(r"\b(?:" + "|".join(STREETS) + r")\b\.?", re.I)
_HOUSE = re.compile(r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room)\.?\s\d+\w?,\s)?(?<![\w.,:/-])\d{1,5}[A-Za-z]? (?:[^\W\d_][\w'’-]* ){1,3}$", re.I)
_CITY = r"(?:,\s(?:\d{4,5}\s)?(?:[A-ZÀ-Þ][\w'’-]+)(?:\s[A-ZÀ-Þ][\w'’-]+)?(?:\s\d{4,5}\b)?)?"
_AFTER_STREET = re.compile(r"(?:,\s(?:Apt|Flat|Unit|Suite)\.?\s\w+)?" + _CITY)
_STREET_FORMS = {
    "fr": re.compile(r"(?<![\w'’-])\d{1,4}(?: (?:bis|ter))?,? (?:rue|place|avenue|chemin|impasse|boulevard|allée|quai|cours|route) [\w'’ -]{2,30}?(?=,|\.|;|$|\n| et | par )" + _CITY, re.I),
    "es": re.compile(r"(?<![\w'’-])(?:Calle|C/|Paseo|Avenida|Avda\.?|Plaza|Camino|Carrera) (?:[^\W\d_][\w'’-]* ){1,4}\d{1,4}(?:, \d{1,2}º? [A-Z]\b)?" + _CITY, re.I),
    "de": re.compile(r"(?<![\w'’-])(?:[A-ZÄÖÜ][\w-]*(?:stra(?:ß|ss)e|str\.?|weg|gasse|platz|allee|winkel|ring|damm|ufer|hang)|(?:Am|An der|Im|Auf dem) [A-ZÄÖÜ][\w-]+) \d{1,4}[a-z]?\b" + _CITY),
    "box": re.compile(r"(?<![\w'’-])(?:(?:P\.?\s?O\.?\s?)?Box \d{1,6}|Postfach \d+|Apartado(?: de correos)? \d+|BP \d{2,6})\b" + _CITY, re.I),
}
#: What must stand in a text (in lower case) for a form to be looked for.
_STREET_HINTS = {
    "fr": ("rue ", "place ", "avenue ", "chemin ", "impasse ", "boulevard ", "allée ", "quai ", "cours ", "route "),
    "es": ("calle ", "c/ ", "paseo ", "avenida ", "avda", "plaza ", "camino ", "carrera "),
    "de": ("straße ", "strasse ", "str. ", "str ", "weg ", "gasse ", "platz ", "allee ", "winkel ", "ring ", "damm ", "ufer ", "hang "),
    "box": ("box ", "postfach ", "apartado ", "bp "),
}
_STREET_OF = {h: form for form, hints in _STREET_HINTS.items() for h in hints}
_STREET = re.compile(r"\b(?:" + "|".join(STREETS) + r")\b")
_STREET_HINT = re.compile("|".join(sorted(map(re.escape, _STREET_OF), key=len, reverse=True)))
_UPPER = "".join(chr(c) for c in range(0x530) if chr(c).isupper())
_CAPITAL = rf"[{_UPPER}][\w'’-]*\.?"
# the first sign decides quickly; a particle before a run is added to it
_RUN = re.compile(rf"[{_UPPER}](?<![\w'’@./-].)[\w'’-]*\.?(?:(?:,? |\n)(?:{_CAPITAL}|(?:{'|'.join(PARTICLES)})\b))+")
_LEADING = re.compile(rf"(?<![\w'’@./-])(?:(?:{'|'.join(x for p in PARTICLES for x in (p, p.title()))}) )+$")
_BETWEEN = re.compile(r",? |\n")
# What stands right before a name, by kind.
NAME_CUES = {
    "title": "Mr Mrs Ms Dr Prof Herr Herrn Frau Mme Mlle Monsieur Madame Sr Sra señor señora doña signor signora".split(),
    "closing": "regards cheers sincerely yours signed Grüßen Grüße Gruß cordialement salutations saludos saludo atentamente saluti".split(),
    "record": "contact name record user customer owner attn client Kunde cliente".split(),
    "asked": """ask for|asked for|spoke with|spoke to|speak with|speak to|talk to|talked to|met|demandez|pregunte por|pregunten por|preguntar por|fragen Sie nach|wenden Sie sich an|question for|
account for|account of|made out to|in the name of|according to""".replace("\n", "").split("|"),
    "called": "name is|named|ich heiße|me llamo|je m'appelle".split("|"),
    "role": "manager colleague Kollege Kollegin person boss Chef collègue compañero compañera".split(),
}
_CUE_KIND = {x.lower(): k for k, v in NAME_CUES.items() for x in v}


def _any_of(words: Iterable[str]) -> str:
    """A pattern of any of the words, the longest first, that is told apart by the first letter."""
    by: dict[str, list[str]] = {}
    for x in sorted(words, key=lambda x: (-len(x), x)):
        by.setdefault(x[0], []).append(re.escape(x[1:]))
    return "(?:" + "|".join(f"{re.escape(k)}(?:{'|'.join(v)})" for k, v in sorted(by.items())) + ")"


_CUED = re.compile(r"\b(" + _any_of({y for v in NAME_CUES.values() for x in v for y in (x[0].lower() + x[1:], x[0].upper() + x[1:], x.upper())}) + r")(?!\w)(?:[.,]|( ?[:=]))?[ \n]?(?=[^\W\d_])")
#: Cues behind which words in small letters may be a name, and what may stand right before an address or a number.
_STRONG = ("title", "closing", "record", "asked", "called")
_SMALL = re.compile(r"[^\W\d_][\w'’-]*\.?(?:,? [^\W\d_][\w'’-]*\.?){1,3}")
_SMALL_BEFORE = re.compile(r"(?<![\w'’@./=-])[^\W\d_][\w'’-]+ (?:[^\W\d_]\. )?[^\W\d_][\w'’-]+(?=[,;]? ?[<(]?(?:tel\.? )?$)")


def _cues(text: str, start: int, end: int) -> set[str]:
    """Cue groups among the last words before the segment, and whether an organisation's word follows."""
    out = set()
    for w in _LEFT.findall(text[max(0, start - 42) : start].lower())[-6:]:
        out.update("cue=" + k for k in _CUE_OF.get(w, ()))
    after = _WORD.match(text, end + 1) if end < len(text) and text[end] in " ,&" else None
    if after and (after[0].lower() in _ORG):
        out.add("org follows")
    return out


def _case(words: list[str]) -> str:
    letters = "".join(words)
    return "upper" if letters.isupper() and len(letters) > 3 else "lower" if letters.islower() else "title" if all(w[:1].isupper() for w in words) else "mixed"


def _kind(word: str) -> str:
    """What a word may be in a name: I(nitial), p(article), G(iven), F(amily), U(nlisted), x (none)."""
    w = word.lower()
    if word.endswith("."):
        return "I" if len(word) == 2 and word[0].isupper() else "x"
    if w in _PARTICLES:
        return "p"
    if w in COMMON or len(w) < 2:
        return "x"
    if w in _GIVEN:
        return "G"
    if w in _FAMILY or not _FAMILY.isdisjoint(re.split(r"[-'’]", w)):
        return "F"
    return "U"


def _names(text: str, others: list[int]) -> Iterator[tuple[int, int, list[str]]]:
    """Name candidates and their features; ``others``: where segments of other kinds begin."""
    cues = {}
    for m in _CUED.finditer(text):
        kind = _CUE_KIND.get(m[1].lower()) or _CUE_KIND[m[1].lower().replace("ss", "ß")]
        if kind != "record" or m[2]:
            cues[m.end()] = kind
    runs = []
    for m in _RUN.finditer(text):
        at = m.start()
        if text[at - 1 : at] == " " and (before := _LEADING.search(text, max(0, at - 16), at)):
            at = before.start()
        runs.append((at, m.end(), True))
    for at, kind in cues.items():
        if kind in _STRONG and text[at].islower() and (m := _SMALL.match(text, at)):
            runs.append((at, m.end(), False))
    for at in others:
        if m := _SMALL_BEFORE.search(text, max(0, at - 50), at):
            runs.append((m.start(), m.end(), False))
    seen = set()
    for start, end, anywhere in runs:
        words, at = [], start
        for gap in _BETWEEN.finditer(text, start, end):
            words.append((at, gap.start(), gap[0]))
            at = gap.end()
        words.append((at, end, ""))
        if len(words) < 2:
            continue
        kinds = [_kind(text[a:b]) for a, b, _ in words]
        # a full stop behind the last word of a sentence isn't its own
        for k, (a, b, gap) in enumerate(words):
            if kinds[k] == "x" and text[b - 1] == "." and b - a > 2:
                words[k], kinds[k] = (a, b - 1, "stop"), _kind(text[a : b - 1])
        for i in range(len(words)) if anywhere else (0,):
            for n in range(2, 6):
                group = words[i : i + n]
                shape = kinds[i : i + n]
                if len(group) < n or shape[-1] == "x" or "x" in shape[:-1] or any(g == "stop" for _, _, g in group[:-1]):
                    break  # and in every longer run
                if shape[-1] == "p" or all(k in "pI" for k in shape) or shape[0] == "p" and "," not in "".join(g for _, _, g in group[:-1]) and (text[group[0][0]].islower() or not any(k in "GF" for k in shape) and group[0][0] not in cues):
                    continue
                gaps = [g for _, _, g in group[:-1]]
                commas = sum("," in g for g in gaps)
                if commas > 1 or commas and "," not in gaps[0] and "," not in gaps[-1]:
                    continue
                a, b = group[0][0], group[-1][1]
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                yield a, b, _name_features(text, a, b, [text[x:y] for x, y, _ in group], "".join(shape), bool(commas), "\n" in gaps, cues.get(a))


def _name_features(text: str, start: int, end: int, words: list[str], shape: str, comma: bool, broken: bool, cue: str | None) -> list[str]:
    plain = re.sub(r"[GFU]", "N", re.sub(r"p+", "p", shape))
    case, listed = _case(words), shape.count("G") + shape.count("F")
    out = ["NAME", f"name={plain}{',' if comma else ''}", f"case={case}", f"given={min(shape.count('G'), 2)}", f"family={min(shape.count('F'), 2)}", f"listed={min(listed, 2)} unlisted={min(shape.count('U'), 3)}"]
    cue = cue or "none"
    out += [f"name cue={cue}", f"name cue={cue} case={case}", f"name cue={cue} listed={min(listed, 1)}"]
    if not _ORG.isdisjoint(w.lower() for w in words):
        out.append("org inside")
    if broken:
        out.append("line break inside")
    before = text[max(0, start - 3) : start]
    if not before.strip(" ") or before.rstrip(" ")[-1:] in ".!?:\n":
        out.append("opens sentence")
    if before[-1:] == " " and (m := _PREVIOUS.search(text, max(0, start - 24), start)):
        word = m[0].strip()
        out.append("capital before" if word[:1].isupper() and word.lower() not in COMMON else f"before={word.lower()}" if word.lower() in _NEAR else "before=other")
    after = text[end : end + 1]
    if after == " ":
        m = _WORD.match(text, end + 1)
        word = m[0] if m else ""
        if word.lower() in _ORG:
            out.append("org follows")
        out.append("after=capital" if word[:1].isupper() and word.lower() not in COMMON else f"after={word.lower()}" if word.lower() in _NEAR else "after=word" if word else "after=(" if text[end + 1 : end + 2] in "(<" else "after=none")
    else:
        out.append("after=" + (after if after in ".,;:?!&'’\n)" and after else "none"))
    if "opens sentence" in out and out[-1].startswith("after="):
        out.append(f"opens sentence {out[-1]}")
    if re.search(r"(?i)(?:db|sql|base|store|stack|cache|load|ql|tools?|data|mesh|works)$", words[-1]):
        out.append("product end")
    return out


_PREVIOUS = re.compile(r"[\w'’]+ $")
# Short words whose place before or behind a name tells something.
_NEAR = set("""of from at in to the by for with and or is are was has on about than via using into says said signs signed wrote asked closed answered called told promised
confirmed von bei aus der die das und hat ist sagt schrieb de del la le les chez et a est dit en y el con dice says kennt lleva répond""".split())


def candidates(text: str) -> list[tuple[int, int, str, list[str]]]:
    """Candidate segments: start, end (exclusive), kind, features."""
    out: list[tuple[int, int, str, list[str]]] = []
    low = text.lower()
    if "@" in text or "＠" in text or " at " in low and " dot " in low or re.search(r"[(\[{]\s?at\s?[)\]}]", low):
        for m in _EMAIL.finditer(text):
            start, s = m.start(), m[0]
            local, _, domain = re.split(r"(\s?(?:@|＠|[(\[{]\s?at\s?[)\]}]|\sat\s)\s?)", s, maxsplit=1, flags=re.I)
            tail = re.split(r"\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s", domain, flags=re.I)
            start += len(local) - len(local.lstrip(".'%-+"))
            sign = "plain" if "@" in s else "wide" if "＠" in s else "spelled"
            out.append((start, m.end(), "EMAIL", ["EMAIL", f"sign={sign}", f"labels={min(len(tail), 4)}", "top=word" if tail[-1].isalpha() and len(tail[-1]) > 1 and len(tail) > 1 else "top=other", "local=word" if re.search(r"[^\W\d_]", local) else "local=other"]))
    digits_there = _DIGIT.search(text)
    for m in [*_NUMBER.finditer(text), *_LOOSE.finditer(text)] if digits_there else ():
        at, s = m.start(), m[0]
        if s[0] == "(" and s.count("(") > s.count(")"):
            at, s = at + 1, s[1:]
        if s[:2] == "((":
            at, s = at + 1, s[1:]
        while s and s.count(")") > s.count("("):
            cut = s.rindex(")")
            s = s[:cut].rstrip()
        for form, pattern in _PHONE_FORMS:
            hit = pattern.match(s)
            if hit and hit.end() >= 7:  # every form competes, with its own end
                digits = sum(c.isdigit() for c in hit[0])
                out.append((at, at + hit.end(), "PHONE", ["PHONE", f"form={form}", f"digits={min(digits, 16)}", f"form={form} digits={min(digits, 16)}", "phone whole" if hit.end() == len(s) else "phone part"]))
    for m in _ID.finditer(text) if digits_there else ():
        for form, pattern in _ID_FORMS:
            if pattern.fullmatch(m[0]):
                out.append((m.start(), m.end(), "ID_NUMBER", ["ID", f"id={form}", "id lower" if m[0].islower() else "id plain"]))
    if digits_there:
        for m in _SUFFIX.finditer(text) if _STREET.search(low) else ():
            head = _HOUSE.search(text, max(0, m.start() - 70), m.start())
            if head:
                middle = [w for w in _WORD.findall(head[0])]
                tail = _AFTER_STREET.match(text, m.end())
                lower = m[0].islower()
                plain = any(w.lower() in _PLAIN for w in middle)
                for end in {m.end(), tail.end()}:  # with and without what may be its city
                    out.append((head.start(), end, "ADDRESS", ["ADDRESS", "street=house first", "street lower" if lower else "street capital", f"words {'plain' if plain else 'names'}", "middle " + _case(middle), "city" if end > m.end() else "no city", "short" if m[0].lower().rstrip(".") in ("st", "dr", "way", "close", "court", "drive", "square", "road") else "long"]))
        for form in {_STREET_OF[h] for h in _STREET_HINT.findall(low)}:
            for m in _STREET_FORMS[form].finditer(text):
                out.append((m.start(), m.end(), "ADDRESS", ["ADDRESS", f"street={form}", "street lower" if m[0].islower() else "street capital", "city" if "," in m[0] else "no city"]))
    out = [(a, b, k, [*f, *(f"{k} {c}" for c in _cues(text, a, b))]) for a, b, k, f in out]
    out += [(a, b, "NAME", f) for a, b, f in _names(text, sorted({x[0] for x in out}))]
    return out


_PLAIN = set("""the a an of and or to in on for with from by at is are was our their your my more less than days hours rows seats tries times minutes seconds
weeks months years users nodes dollars euros people files tables queries percent per new old""".split())


def weights(path: Path = WEIGHTS) -> dict[str, float]:
    return json.loads(path.read_text())


#: Segments this close (characters between them) are neighbours.
NEAR = 24


def neighbours(a: tuple[int, int, str], b: tuple[int, int, str]) -> str | None:
    """The feature of two segments (start, end, kind) that follow one another closely."""
    gap = b[0] - a[1]
    return f"{a[2]} then {b[2]} {'touching' if gap <= 3 else 'near'}" if 0 <= gap <= NEAR else None


def decode(text: str, w: dict[str, float]) -> list[tuple[int, int, str]]:
    """The best set of disjoint segments: start, end, kind, by start."""
    found = [(b, a, k, sum(w.get(f, 0.0) for f in fs)) for a, b, k, fs in candidates(text)]
    found = sorted(x for x in found if x[3] > -REACH)
    if not found:
        return []
    ends = [x[0] for x in found]
    # best[i]: of all sets of the first i segments; last[i]: of those that end with the i-th
    best, last, back = [0.0], [], []
    for i, (b, a, k, s) in enumerate(found):
        j = bisect_right(ends, a - NEAR - 1, 0, i)  # those before it are no neighbours
        value, from_ = best[j], None
        for h in range(j, bisect_right(ends, a, j, i)):
            t = last[h] + w.get(neighbours((found[h][1], ends[h], found[h][2]), (a, b, k)) or "", 0.0)
            if t > value:
                value, from_ = t, h
        last.append(value + s)
        back.append((from_, j))
        best.append(max(best[i], last[i]))
    out, i = [], len(found)
    while i:
        if best[i] == best[i - 1]:
            i -= 1
            continue
        i -= 1
        while True:
            b, a, k, _ = found[i]
            out.append((a, b, k))
            from_, j = back[i]
            if from_ is None:
                i = j
                break
            i = from_
    return out[::-1]


#: The most that neighbours add to a segment; one below minus this is in no best set.
REACH = 3.0


def marginals(spans: list[tuple[int, int, float]]) -> tuple[float, list[float]]:
    """log Z over all sets of disjoint segments (start, end, potential), and each segment's probability."""
    return expectations(spans, [""] * len(spans), {})[:2]


def expectations(spans: list[tuple[int, int, float]], kinds: list[str], w: dict[str, float]) -> tuple[float, list[float], dict[str, float]]:
    """log Z over all sets of disjoint segments (start, end, potential), each segment's probability, and the expected number
    of each feature of neighbours."""
    n = len(spans)
    order = sorted(range(n), key=lambda i: (spans[i][1], spans[i][0]))
    add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))

    def follow(i: int, j: int) -> float:
        return w.get(neighbours((*spans[i][:2], kinds[i]), (*spans[j][:2], kinds[j])) or "", 0.0)

    ahead, behind = [0.0] * n, [0.0] * n  # sets up to a segment (itself included), and from it on (itself left out)
    for j in order:
        total = 0.0
        for i in order:
            if spans[i][1] <= spans[j][0]:
                total = add(total, ahead[i] + follow(i, j))
        ahead[j] = total + spans[j][2]
    for i in sorted(range(n), key=lambda i: (-spans[i][0], -spans[i][1])):
        total = 0.0
        for j in range(n):
            if spans[j][0] >= spans[i][1]:
                total = add(total, follow(i, j) + spans[j][2] + behind[j])
        behind[i] = total
    z = 0.0
    for a in ahead:
        z = add(z, a)
    expected: dict[str, float] = {}
    for i in range(n):
        for j in range(n):
            f = neighbours((*spans[i][:2], kinds[i]), (*spans[j][:2], kinds[j])) if spans[j][0] >= spans[i][1] else None
            if f:
                expected[f] = expected.get(f, 0.0) + math.exp(ahead[i] + follow(i, j) + spans[j][2] + behind[j] - z)
    return z, [math.exp(ahead[i] + behind[i] - z) for i in range(n)], expected


def mask(text: str | None, w: dict[str, float]) -> str | None:
    """The text with each segment replaced by its kind in brackets."""
    if not text:
        return text
    out, at = [], 0
    for a, b, k in decode(text, w):
        out += [text[at:a], f"[{k}]"]
        at = b
    return "".join([*out, text[at:]])


def _find(w: dict[str, float], fields: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, names, kinds, starts, ends = [], [], [], [], []
            for name in fields:
                for i, text in enumerate(b.column(name).to_pylist()):
                    for x, y, k in decode(text, w) if text else ():
                        rows.append(i)
                        names.append(name)
                        kinds.append(k)
                        starts.append(x)
                        ends.append(y)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["id", "field_name", "kind", "start_pos", "end_pos"])

    return run


def find(df: DataFrame, row_id: str, *fields: str) -> DataFrame:
    """One row per occurrence: ``row_id``, field_name, kind, start_pos, end_pos (exclusive; code points from 0).

    Null and empty texts have none; texts are read whole; equal rows come out once each; null ids are kept. No shuffle.
    """
    kind = df.schema[row_id].dataType.simpleString()
    rows = df.select(F.col(row_id).alias("id"), *[F.col(f).cast("string").alias(f) for f in fields])
    return rows.mapInArrow(_find(weights(), fields), f"id {kind}, field_name string, kind string, start_pos bigint, end_pos bigint").withColumnRenamed("id", row_id)


def redact(df: DataFrame, row_id: str, *fields: str) -> DataFrame:
    """``row_id`` and the fields with typed placeholders ([EMAIL], ...); nulls stay null, the rest of a text is unchanged."""
    w = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([mask(t, w) for t in b.column(f).to_pylist()], pa.string()) for f in fields)], ["id", *fields])

    kind = df.schema[row_id].dataType.simpleString()
    rows = df.select(F.col(row_id).alias("id"), *[F.col(f).cast("string").alias(f) for f in fields])
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"`{f}` string" for f in fields)).withColumnRenamed("id", row_id)
