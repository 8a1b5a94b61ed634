"""Personal information inside free text, by weakly supervised labelers.

For each kind of information a generator proposes spans by their form alone (on a tidied copy of the text whose
characters point back to their places).  Labelers vote on each span: forms and check digits, the gazetteer and the
shape of words learned from it, and words near the span that are the usual ones for such information or for other
numbers.  The votes of all spans of the whole table are counted by pattern, and expectation-maximisation estimates
from these counts how reliable each labeler is.  Its posteriors are the soft labels from which the final span
classifier is trained, on a bounded sample of spans (``FIT_SPANS`` for each kind); that classifier, which also sees
the words around a span and so learns phrases that no labeler lists, decides.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.workspace import in_arrow, materialize, spread

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
#: Spans of each kind on which the final classifier is trained at most, those with the smallest hash.
FIT_SPANS = 6000
#: Hashed context features of the classifier, its most rounds, and the gradient at which it stops before.
CONTEXT_BUCKETS = 2048
FIT_ROUNDS, FIT_GRADIENT = 3000, 2e-4
EM_ROUNDS = 30
#: A gazetteer up to this size is sent to every task; of a larger one each text gets the names that stand in it, by a join.
MAX_NAMES = 200_000
#: Most frequent words of the texts against which the shape of names is learned, and the least log odds of a name.
ORDINARY_WORDS = 5000
NAME_SHAPE = 3.0

_INVISIBLE = frozenset("\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f")
_SAME = str.maketrans(
    {
        **dict.fromkeys("\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\n\r\t\x0b\x0c\x85\u2028\u2029", " "),
        **dict.fromkeys("\u2010\u2011\u2012\u2013", "-"),
        **dict.fromkeys("\u2018\u2019\u02bc", "'"),
        "＠": "@",
        "＋": "+",
        **dict(zip("аеорсухіѕј", "aeopcyxisj")),
        **dict(zip("АВЕКМНОРСТХ", "ABEKMHOPCTX")),
        **dict(zip("０１２３４５６７８９", "0123456789")),
    }
)


def tidy(text: str) -> tuple[str, list[int] | None]:
    """The text with plain spaces, hyphens, quotes and letters, and the place of each of its characters (None: the same)."""
    if text.isascii():
        return text if text.isprintable() else text.translate(_SAME), None
    chars, places = [], []
    for i, c in enumerate(text):
        if c in _INVISIBLE:
            continue
        if chars and unicodedata.combining(c):
            joined = unicodedata.normalize("NFC", chars[-1] + c)
            if len(joined) == 1:
                chars[-1] = joined
                continue
        chars.append(c)
        places.append(i)
    return "".join(chars).translate(_SAME), places


# ---------------------------------------------------------------- words

_WORD = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")
_TITLES = frozenset(
    """mr mrs ms miss mx dr prof professor doctor nurse captain sir madam dame lord lady coach judge pastor rev reverend father
    sergeant officer herr frau fräulein doktor professorin kapitän schwester docteur monsieur madame mademoiselle mme mlle
    maître professeur capitaine infirmière infirmier don doña señor señora señorita sr sra srta dra doctora profesor profesora
    capitán enfermera enfermero""".split()
)
_SHORT_TITLES = frozenset("mr mrs ms mx dr prof rev mme mlle sr sra srta dra".split())
# Words that begin a sentence or lead up to a name, and are no given names.
_LEAD = frozenset(
    """ask hi hey dear the they then that this my our we i it so thanks and with from by for to met put hier gestern ayer ich wir frau herr
    mein meine der die das sie er es le la les un une je nous mon ma el los mi vi yo regards sincerely name applicant when where who what""".split()
)
_STREET_TYPES = (
    "street st road rd lane ln avenue ave close court ct drive dr way row terrace place square crescent boulevard blvd hill gardens grove walk mews parade trail circle parkway pkwy highway alley quay esplanade".split()
)
_STREET_WORD = frozenset(_STREET_TYPES)
_SMALL = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_NUMBER_WORD = rf"(?:(?:{'|'.join(_TENS)})(?:[- ](?:{'|'.join(_SMALL[:9])}))?|{'|'.join(reversed(_SMALL))}|(?:one|a) hundred(?: and)?(?: (?:{'|'.join(_SMALL + _TENS)}))?)"
_DIGIT_WORDS = """zero oh one two three four five six seven eight nine double triple null eins zwei zwo drei vier fünf sechs sieben acht neun
    zéro un deux trois quatre cinq sept huit neuf cero uno dos tres cuatro cinco seis siete ocho nueve""".split()
_DIGIT_WORD = frozenset(_DIGIT_WORDS)
_DIGIT = re.compile(r"\d")
# Without a word built like a family name, a name needs a capital behind a capitalised word, an initial or a title.
_TWO_CAPITALS = re.compile(r"\b(?:[^\W\d_a-z][\w'-]*\s+|[^\W\d_]{1,4}\.\s*)[^\W\d_a-z]")
_LETTERS = re.compile(r"[^\W\d_]+")
_PARTICLES = frozenset("van von der den de la del di da le el zu zum".split())

# ---------------------------------------------------------------- generators

_AT = r"(?:\s?@\s?|\s*[(\[{<]\s*(?:at|@|arroba)\s*[)\]}>]\s*)"
_SPELLED_AT = r"(?:\s+(?:at|arroba|chez)\s+)"
_DOT = r"(?:\.|\s*[(\[{<]\s*(?:dot|\.|punto|punkt|point)\s*[)\]}>]\s*|\s+(?:dot|punkt|point|punto)\s+)"
_LOCAL = rf"[^\W_](?:[\w+%'-]|{_DOT}(?=\w))*"
_DOMAIN = rf"(?:[\w-]+{_DOT})+[^\W\d_]{{2,}}"
_EMAIL = re.compile(rf"(?<![\w.+%-])({_LOCAL})({_AT})({_DOMAIN})", re.I)
_SPELLED_EMAIL = re.compile(rf"(?<![\w.+%-])([^\W_][\w.+%'-]*)({_SPELLED_AT})({_DOMAIN})", re.I)
_PHONE = re.compile(r"(?<![\w#/.-])(?:\+\s?|\()?\d(?:[\s().\-/]{0,3}\d){8,14}(?![\w-])")
_SPOKEN = re.compile(rf"\b(?:{'|'.join(_DIGIT_WORDS)})(?:[\s,-]+(?:{'|'.join(_DIGIT_WORDS)})){{6,14}}\b", re.I)
_ID = re.compile(
    r"(?<![\w/#-])(?:\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,3}\d{6,9}[A-Z]?|\d{8}[- ]?[A-Z]|[A-Z]{5}-?\d{6}-?[A-Z0-9]{3}"
    r"|\d{2,3}/\d{3}/\d{4,5}|\d{2} \d{3} \d{3} \d{3}|\d{9,13}|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?|(?=(?:[A-Z]*\d){5})[A-Z][A-Z0-9]{8}|[XYZ]\d{7}-?[A-Z]|(?=[A-Z0-9-]*\d[A-Z0-9-]*\d)[A-Z0-9]{2,}(?:-[A-Z0-9]{2,}){1,3})(?![\w/]|-\w)",
    re.I,
)
_UNIT = r"(?:(?:flat|apt|apartment|unit|suite|room|wohnung|piso|appartement|appt)\.?\s*#?\d*[a-z]?\d*\s*,\s*)"
_STREET = re.compile(
    rf"(?<![\w/#-])({_UNIT})?(\d{{1,5}}\s?[a-z]?|{_NUMBER_WORD}),?\s+((?:[^\W\d_][\w'.-]*\s+){{1,3}}?)({'|'.join(_STREET_TYPES)})\b\.?", re.I
)
_RUE = re.compile(
    rf"(?<![\w/#-])({_UNIT})?\d{{1,5}}\s?(?:bis|ter|quater|[a-z])?,?\s+(?:rue|avenue|place|chemin|quai|impasse|boulevard|allée|cours|square|route|passage|villa|sentier)\s+(?:(?:de|du|des|la|le|les|l'|d')\s*)*[^\W\d_][\w'-]*(?:\s+[A-ZÀ-Þ][\w'-]*)?",
    re.I,
)
_CALLE = re.compile(
    r"(?<!\w)(?:c/|calle|avenida|avda\.?|plaza|paseo|camino|carrer|ronda|travesía|carretera|vía|via|viale|piazza|corso|largo|rua|travessa)\s*(?<=[\s/])(?:(?:de|del|la|las|los|el)\s+)*[^\W\d_][\w'-]*(?:\s+[^\W\d_][\w'-]*)?,?\s+(?:n[.º°]\s*)?\d{1,5}\b", re.I
)
_STRASSE = re.compile(
    r"(?<!\w)(?:(?:[^\W\d_][\w-]*(?:str\.|straße|strasse|weg|gasse|platz|allee|ring|ufer|damm|steig|hof))|(?:am|an der|auf der|im|zum|zur|unter den|alte[rn]?|neue[rn]?|lange)\s+[^\W\d_][\w-]*(?:\s+(?:straße|str\.|weg|gasse))?)\s+\d{1,4}\s?[a-z]?\b",
    re.I,
)
_BOX = re.compile(r"\b(?:p\.?\s?o\.?\s?box|post office box|postfach|apartado(?: de correos)?|bo[iî]te postale|b\.?p\.?|casilla)\s*(?:n[.º°o]\s*)?\d{1,6}\b", re.I)

# ---------------------------------------------------------------- contexts

# Usual words before each kind of information, in the languages that are told apart here.
_CUES = {
    "email": frozenset("mail email mails mailto inbox contact write address adresse correo kontakt schreib schreiben écris écrivez écrire escríbeme escribe escribir courriel".split()),
    "phone": frozenset(
        """tel phone telephone telefon telefonnummer téléphone teléfono number numbers numéro nummer número call calls called calling text texts ring reach dial sms whatsapp
        mobile cell fax handy portable móvil celular appelle appeler appelez llámame llamar llame ruf rufen anrufen anruf joindre joignable erreichbar""".split()
    ),
    "id_number": frozenset(
        """id ids identity identification identifier ssn social security insurance ni nino passport passports licence license tax taxpayer tin itin national
        ausweis ausweisnummer personalausweis personalausweisnummer pass passnummer reisepass reisepassnummer führerschein führerscheinnummer steuer steuernummer identifikationsnummer
        steueridentifikationsnummer sozialversicherung sozialversicherungsnummer rentenversicherungsnummer versicherungsnummer
        passeport identité permis sécurité sociale fiscal fiscale nir cni dni nie nif pasaporte carnet identidad seguridad licencia conducir cédula""".split()
    ),
    "street_address": frozenset(
        """live lives living lived address place home house flat apartment parcel package deliver delivered delivery ship shipped send sent moved move stay staying
        come visit meet adresse wohnen wohne wohnt wohnung habitons habite habitent livrer dirección vivimos vivo vive domicilio anschrift zuhause""".split()
    ),
    "person_name": frozenset(
        """name names named signed behalf applicant patient client customer met meet ask asked spoke talked regards sincerely dear contact lunch dinner letter with from by
        heißt heiße namen unterschrieben getroffen rief nom appelle rencontré signé llamo llama nombre firmado conocí vi habe""".split()
    ),
}
# Usual words before numbers that are none of a person.
_OTHER_NUMBER = frozenset(
    """isbn order orders tracking parcel meter reading flight booking reservation reference ref code serial model invoice ticket lottery firmware version gate room score page
    barcode sku batch build bestellung bestellnummer sendung sendungsnummer buchung rechnung flug zählerstand commande colis vol facture réservation pedido vuelo reserva factura envío""".split()
)
_MEASURE = re.compile(r"\s*(?:kwh|kw|km|miles?|kg|euros?|dollars?|pounds|€|\$|£|%|percent|steps|hours?|days?|weeks?|months?|years?|minutes?|people|times|points)\b", re.I)
_EXTENSION = re.compile(r"\s*,?\s*(?:ext\b|extension|durchwahl|poste\b)", re.I)
_LOCALITY = re.compile(r"\s*,\s*(?:[A-ZÀ-Þ]|\d{4,5}\b|apt|apartment|flat|floor|unit|suite|piso|étage|\d+º)|\s+\d{5}\b|\s+(?:apt|flat|unit|floor|suite)\b", re.I)
_CHANNEL = re.compile(r"[:<(]\s*$")
_SENTENCE_END = re.compile(r"(?:[!?]|(?<=[^\W_]{4})\.|(?<=\d)\.)\s+(?=\S)")
# Words that join a number or an address to the words that announce it.
_BETWEEN = frozenset("is ist est es no nr number num nummer número numéro n card the my without dashes it says reads was of".split())


def _before(text: str, start: int) -> list[str]:
    """The last words, in small letters, of the sentence that leads up to a place."""
    said = _SENTENCE_END.split(text[max(0, start - 70) : start])[-1]
    return [w.lower() for w in _WORD.findall(said)[-6:]]


def _near(kind: str, words: list[str]) -> bool:
    return not _CUES[kind].isdisjoint(words)


def _announced(kind: str, words: list[str]) -> bool:
    """A cue stands right before the place, but for words that join the two."""
    left = next((w for w in reversed(words) if w not in _BETWEEN or w in _CUES[kind]), "")
    return left in _CUES[kind]


# ---------------------------------------------------------------- names


def _shape(word: str) -> list[str]:
    """Beginnings and ends by which the shape of a name is judged."""
    return [f"^{word[:2]}", f"^{word[:3]}", f"{word[-2:]}$", f"{word[-3:]}$", f"{word[-4:]}$"]


def fold(name: str | None) -> str:
    return unicodedata.normalize("NFC", name or "").lower().replace("’", "'").strip()


@dataclass
class Names:
    """Gazetteer of names, and the shape of names by naive Bayes: log odds of beginnings and ends against ordinary words."""

    family: frozenset = frozenset()
    given: frozenset = frozenset()
    odds: tuple[dict, dict] = field(default_factory=lambda: ({}, {}))
    unseen: tuple[float, float] = (0.0, 0.0)
    longer: frozenset = field(default_factory=frozenset)
    votes: tuple[dict, dict] = field(default_factory=lambda: ({}, {}))

    @staticmethod
    def of(rows: list[tuple[str, str]], ordinary: list[str] | None = None) -> Names:
        family = frozenset(fold(n) for n, k in rows if k == "family" and n)
        given = frozenset(fold(n) for n, k in rows if k == "given" and n)
        counts = [Counter(f for n in names for f in _shape(n)) for names in (family, given)]
        return Names(family, given, longer=frozenset(n for n in family if " " in n)).shaped(counts, [len(family), len(given)], ordinary or [])

    def shaped(self, counts: list[Counter], sizes: list[int], ordinary: list[str]) -> Names:
        """With the shape of names that have these counts of beginnings and ends, against the ordinary words."""
        words = {w for w in map(fold, ordinary) if len(w) > 2} - self.family - self.given
        others = Counter(f for w in words for f in _shape(w))
        odds, unseen = [], []
        for counted, n in zip(counts, sizes):
            rate = lambda c, of: math.log((c + 0.5) / (of + 1.0))
            odds.append({f: max(-3.0, min(3.0, rate(c, n) - rate(others[f], len(words)))) for f, c in counted.items() if c > 1} if n > 1 else {})
            unseen.append(-1.5)
        self.odds, self.unseen = (odds[0], odds[1]), (unseen[0], unseen[1])
        return self

    def only(self, family: list[str], given: list[str]) -> Names:
        """The same shapes, with the names that stand in one text."""
        known = frozenset(family)
        return Names(known, frozenset(given), self.odds, self.unseen, frozenset(n for n in known if " " in n))

    def _remembered(self, which: int, word: str, vote) -> int:
        known = self.votes[which]
        if word not in known:
            if len(known) > 200_000:
                known.clear()
            known[word] = vote(word.lower())
        return known[word]

    def family_vote(self, word: str) -> int:
        """1 for a known family name, 2 for one shaped like known ones, 0 for neither."""
        return self._remembered(0, word, self._family_vote)

    def given_vote(self, word: str) -> int:
        return self._remembered(1, word, self._given_vote)

    def _shaped_like(self, which: int, word: str) -> float:
        known = self.odds[which]
        return sum(known.get(f, self.unseen[which]) for f in _shape(word)) if known else -9.0

    def _family_vote(self, w: str) -> int:
        parts = w.split("-")
        if w in self.family or (len(parts) > 1 and any(p in self.family for p in parts)):
            return 1
        if w in self.given:
            return 0
        return 2 if any(len(p) > 5 and (f := self._shaped_like(0, p)) >= NAME_SHAPE and f > self._shaped_like(1, p) for p in parts) else 0

    def _given_vote(self, w: str) -> int:
        if w in self.given:
            return 1
        return 2 if len(w) > 3 and w not in self.family and (g := self._shaped_like(1, w)) >= NAME_SHAPE and g >= self._shaped_like(0, w) else 0


# Ordinary words among the family names of most lists; alone in lower case they are no names.
_ORDINARY = frozenset(
    """april august autumn baker bell bishop black bloom brown bush butler carpenter christian clay cook cooper daisy dawn day faith field fisher flower ford forest fox garden
    gardner glass grace grant green hill holly hope hunter iris ivy joy june king lake lane law lily long mark mason may melody miller mills moon olive park parker pearl
    pierce pope porter potter price rich rivers robin rose ruby short smith stone street summer sunny taylor walker ward water waters west white will winter wood woods young""".split()
)
_PLACE_WORDS = frozenset(
    """airport bakery bridge cafe centre center choir church club college council county fair festival garden gardens hall harbour hospital hotel library market museum
    orchestra park restaurant river school shop stadium station store team theatre university""".split()
)
_MONTHS = frozenset("january february march april may june july august september october november december".split())


@dataclass
class Span:
    kind: str
    start: int
    end: int
    votes: tuple[int, ...]
    context: list[str]


def _vote(yes: bool, no: bool = False) -> int:
    return 1 if yes else -1 if no else 0


def _emails(text: str) -> Iterator[tuple[int, int, tuple]]:
    covered: list[tuple[int, int]] = []
    for pattern in (_EMAIL, _SPELLED_EMAIL):
        at = 0
        while m := pattern.search(text, at):
            local, sign, domain = m.groups()
            start, at = m.start(), m.end()
            spelled = pattern is _SPELLED_EMAIL
            spelled_dots = bool(re.search(r"[\s(\[{<](?:dot|punkt|point|punto)[\s)\]}>]", domain, re.I))
            known_end = bool(re.search(r"\b(?:example|test|invalid|com|org|net|de|fr|es|uk|io|edu|info)$", domain, re.I))
            if spelled and not (spelled_dots or known_end) or any(s < m.end() and start < e for s, e in covered):
                at = start + 1
                continue
            if " " in local.strip():  # a spelled dot in the local part, or words before it
                head = re.match(rf"(?:.*\s)?((?:[\w+%'-]|{_DOT})+)$", local, re.I)
                start += head.start(1) if head and not re.search(r"\s(?:dot|punkt|point|punto)\s", local, re.I) else 0
            before = _before(text, start)
            votes = (
                _vote("@" in sign, spelled and not spelled_dots),
                _vote(bool(re.search(r"[\d.+_-]|\bdot\b", local)) or len(local) > 4, len(local) < 2),
                _vote(_near("email", before) or bool(_CHANNEL.search(text[max(0, start - 3) : start])), not _OTHER_NUMBER.isdisjoint(before)),
                _vote(spelled_dots or known_end, not known_end and not spelled_dots),
            )
            covered.append((start, m.end()))
            yield start, m.end(), votes


def _phones(text: str) -> Iterator[tuple[int, int, tuple]]:
    for m in _PHONE.finditer(text):
        found = m.group()
        digits = re.sub(r"\D", "", found)
        if not 9 <= len(digits) <= 15 or (len(digits) == 9 and "+" not in found):
            continue
        before = _before(text, m.start())
        groups = [len(g) for g in re.findall(r"\d+", found)]
        ssn = groups == [3, 2, 4]
        # National and international ways of writing phone numbers.
        form = bool(re.match(r"\+|00|\(0?\d{2,4}\)|0\d|1?[-. ]?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}$|\d{10}$", found))
        other = not _OTHER_NUMBER.isdisjoint(before) or _announced("id_number", before)
        votes = (
            _vote(form and not ssn, ssn or len(groups) > 6 or groups[:1] == [13]),
            _vote(_near("phone", before) and not other, other),
            _vote(bool(_EXTENSION.match(text, m.end())), bool(_MEASURE.match(text, m.end()))),
            _vote("+" in found or "(" in found or found.startswith("00") or len(digits) in (10, 11), "," in found or _isbn(digits)),
        )
        yield m.start(), m.end(), votes
    for m in _SPOKEN.finditer(text):
        before = _before(text, m.start())
        yield m.start(), m.end(), (1, _vote(_near("phone", before), not _OTHER_NUMBER.isdisjoint(before)), _vote(bool(_EXTENSION.match(text, m.end()))), 1)


def _isbn(digits: str) -> bool:
    return len(digits) == 13 and digits[:3] in ("978", "979") and sum(int(d) * (1, 3)[i % 2] for i, d in enumerate(digits)) % 10 == 0


def _check_digit(found: str) -> bool:
    """Valid check letters or digits of the identity numbers that have them."""
    plain = re.sub(r"[\s/-]", "", found).upper()
    if m := re.fullmatch(r"([XYZ]?)(\d{7,8})([A-Z])", plain):
        number = f"{'XYZ'.index(m[1])}{m[2]}" if m[1] else m[2]
        return len(number) == 8 and "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23] == m[3]
    if re.fullmatch(r"[12]\d{14}", plain):
        return 97 - int(plain[:13]) % 97 == int(plain[13:])
    if re.fullmatch(r"[1-9]\d{10}", plain):
        product = 10
        for d in plain[:10]:
            total = (int(d) + product) % 10 or 10
            product = 2 * total % 11
        return (11 - product) % 10 == int(plain[10])
    return False


_ID_FORM = re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]{1,2}\d{7,8}|[A-Z]{5}-?\d{6}-?\w{3}|\d{2,3}/\d{3}/\d{4,5}|[XYZ]?\d{7,8}-?[A-Z]|[CFGHJK][0-9CFGHJKLMNPRTVWXYZ]{8}|\d{2} ?\d{6} ?[A-Z] ?\d{3}", re.I)
# Forms that no other usual number has.
_ID_ONLY = re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]{5}-?\d{6}-?[A-Z0-9]{3}|[XYZ]\d{7}-?[A-Z]", re.I)


def _ids(text: str) -> Iterator[tuple[int, int, tuple]]:
    for m in _ID.finditer(text):
        found = m.group()
        plain = re.sub(r"\D", "", found)
        if len(plain) < 6:
            continue
        before = _before(text, m.start())
        near, other = _near("id_number", before), not _OTHER_NUMBER.isdisjoint(before)
        called = _announced("phone", before) and not near
        votes = (
            _vote(bool(_ID_FORM.fullmatch(found)), found.startswith(("978-", "979-")) and len(plain) >= 12),
            _vote(near and not other, other or called),
            _vote(_announced("id_number", before), bool(_MEASURE.match(text, m.end()))),
            _vote(bool(_ID_ONLY.fullmatch(found)) or _check_digit(found), _isbn(plain)),
        )
        yield m.start(), m.end(), votes


def _streets(text: str, patterns: list[re.Pattern]) -> Iterator[tuple[int, int, tuple]]:
    for pattern in patterns:
        for m in pattern.finditer(text):
            before = _before(text, m.start())
            near = _near("street_address", before)
            # A place is named right after a preposition or a colon.
            placed = bool(before and before[-1] in _TO_PLACE) or bool(_CHANNEL.search(text[max(0, m.start() - 3) : m.start()]))
            wrong, capital = False, True
            if pattern is _STREET:
                names = m.group(3).split()
                capital = all(w[:1].isupper() for w in names) and m.group(4)[:1].isupper()
                # A sentence goes on: "75001 Lutetia. New place", "20 people and a place".
                mixed = all(w[:1].isupper() for w in names) and m.group(4)[:1].islower()
                wrong = mixed or any(w.lower().strip(".") in _NOT_IN_STREET for w in names)
            elif pattern is _STRASSE:
                wrong = not re.search(r"(?:str\.|straße|strasse|weg|gasse|platz|allee)\s", m.group(), re.I) and not near
            votes = (
                _vote(capital and not wrong, wrong),
                _vote(near and not wrong, wrong),
                _vote(placed and not wrong, not placed and not near and not capital),
                _vote(bool(_LOCALITY.match(text, m.end())), bool(_MEASURE.match(text, m.end()))),
            )
            yield m.start(), m.end(), votes


_TO_PLACE = frozenset("at to in on is der dem au à en ist est es".split())
# Words of sentences and of measures, of which no street's name consists.
_NOT_IN_STREET = frozenset(
    """hour hours day days week weeks month months year years minute minutes second seconds km miles metres meters times people person percent euros dollars pounds
    of the and to from for in at on is was were are that this my our your his her their it we they he she i a an by with than then ago per or but so as near into around about""".split()
)


def _people(text: str, names: Names) -> Iterator[tuple[int, int, tuple]]:
    words = []
    for m in _WORD.finditer(text):
        word, end = m.group(), m.end()
        if word[-2:].lower() == "'s":
            word, end = word[:-2], end - 2
        words.append((word, m.start(), end))
    shouting = text.upper() == text
    french: list[bool] = []

    def is_french() -> bool:
        if not french:
            french.append(bool(re.search(r"\b(?:j'ai|hier|a appelé|le|les|est|et|suis|avec)\b", text, re.I)))
        return french[0]

    n = len(words)

    def gap(i: int) -> str:
        return text[words[i][2] : words[i + 1][1]]

    def is_title(i: int) -> bool:
        w = words[i][0].lower()
        return w in _TITLES and (gap(i).isspace() or w in _SHORT_TITLES and gap(i).strip() == "." and gap(i)[0] == ".")

    def is_initial(i: int) -> bool:
        w = words[i][0]
        return len(w) == 1 and gap(i).startswith(".") and gap(i).strip() == "." or len(w) == 1 and w.isupper() and w not in "IAOY" and gap(i) == " "

    used = -1
    for i in range(n):
        if i <= used:
            continue
        word, start, end = words[i]
        first, last_word = i, i
        family, family_kind = word, names.family_vote(word)
        low = word.lower()
        if not family_kind and low not in _PARTICLES:
            # Not built like a family name: only behind an initial, a title or a given name.
            before = words[i - 1][0] if i else ""
            if not word[:1].isupper() or not (len(before) == 1 or before.lower() in _TITLES or before and names.given_vote(before)):
                continue
        # Names of several words, and particles before a name.
        j = i
        if low in _PARTICLES and i + 1 < n:
            while j + 1 < n and words[j][0].lower() in _PARTICLES and gap(j).isspace():
                j += 1
            joined = " ".join(w[0] for w in words[i : j + 1]).lower()
            if j > i and (joined in names.longer or names.family_vote(words[j][0])):
                family, family_kind, end, last_word = joined, 1, words[j][2], j
            elif j > i and words[j][0][:1].isupper() and low != "a":
                family, family_kind, end, last_word = joined, 0, words[j][2], j
            else:
                continue
        # What stands before the family name.
        title = given = initial = 0
        k = first - 1
        if k >= 0 and words[k][0] == "M" and gap(k).strip() == "." and (is_french() or names.given_vote(word)):
            title, k = 1, k - 1
        elif k >= 0 and is_initial(k) and (words[k][0].isupper() or words[k][0] not in "aist" + "m"):
            initial, first, k = 1, k, k - 1
        if k >= 0 and gap(k).isspace() and names.given_vote(words[k][0]):
            given, first, k = names.given_vote(words[k][0]), k, k - 1
            if k >= 0 and words[k][0] == "M" and gap(k).strip() == ".":
                title, k = 1, k - 1
        elif k >= 0 and family_kind and gap(k).isspace() and words[k][0][:1].isupper() and len(words[k][0]) > 2 and not is_title(k):
            # A given name outside the list.
            if words[k][0].lower() not in _LEAD and not names.family_vote(words[k][0]):
                given, first, k = 2, k, k - 1
        if k >= 0 and is_title(k) and (words[k][0][:1].isupper() or family_kind or not word[:1].isupper()):
            title, k = 1, k - 1
        # Family name first.
        reversed_given = 0
        if not (title or given or initial) and last_word + 1 < n and family_kind and (low not in _ORDINARY or word[:1].isupper()):
            between = gap(last_word)
            if between.strip() == "," and between.endswith(" ") or between.isspace():
                reversed_given = names.given_vote(words[last_word + 1][0])
                if between.isspace() and (reversed_given != 1 or words[last_word + 1][0][:1].isupper() != word[:1].isupper()):
                    reversed_given = 0
                if reversed_given:
                    end, last_word = words[last_word + 1][2], last_word + 1
        if not (title or given or initial or reversed_given):
            continue
        if not family_kind:
            # A family name outside the list: only with a capital, and not where a sentence simply goes on.
            if not (title or given) and not _announced("person_name", _before(text, words[first][1])):
                continue
            if last_word + 1 < n and (names.family_vote(words[last_word + 1][0]) or last_word + 2 < n and is_initial(last_word + 1) and names.family_vote(words[last_word + 2][0])):
                continue
            if low in _PLACE_WORDS or not word[:1].isupper() or names.given_vote(word) or shouting or low in _TITLES or low in _STREET_WORD or len(word) < 3:
                continue
        begin = words[first][1]
        before = [w for w in _before(text, begin) if w not in _TITLES]
        following = words[last_word + 1][0].lower() if last_word + 1 < n and gap(last_word).isspace() else ""
        street = following in _STREET_WORD or following in _PLACE_WORDS
        # An ordinary word in lower case beside a capital: "I hope August".
        uneven = not title and words[first][0][:1].islower() and word[:1].isupper() and len(words[first][0]) > 1
        ordinary = (low in _ORDINARY and not word[:1].isupper() and not (given or title)) or uneven or low in _MONTHS
        votes = (
            _vote(family_kind == 1 and not ordinary and not street, ordinary),
            _vote(family_kind > 0 and not ordinary and not street, street or ordinary),
            _vote(bool(given == 1 or reversed_given == 1 or title or initial) and not uneven, uneven),
            _vote(_near("person_name", before[-3:]) and not street, street),
            _vote(bool(title or initial or family_kind == 1 and given == 1) and not street, street or uneven),
        )
        yield begin, end, votes
        used = last_word


_TOKEN = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*|\d+|[^\w\s]")


def _context(text: str, start: int, end: int) -> list[str]:
    """Words and signs around a place: the three before and the two after it, and the pairs next to it."""
    left, right = _TOKEN.findall(text[max(0, start - 40) : start].lower())[-3:], _TOKEN.findall(text[end : end + 30].lower())[:2]
    tags = [f"l:{w}" for w in left] + [f"r:{w}" for w in right]
    return tags + [f"ll:{' '.join(left[-2:])}", f"lll:{' '.join(left)}", f"l1:{left[-1] if left else ''}", f"r1:{right[0] if right else ''}", f"rr:{' '.join(right)}"]


def _possible(plain: str, names: Names) -> tuple[bool, bool, bool, list[re.Pattern], bool]:
    """What a text can hold at all: emails, figures, phone numbers, which forms of addresses, names."""
    # Words are split at hyphens and apostrophes, as the forms below join them in either way.
    words = _LETTERS.findall(plain)
    low = {w.lower() for w in words}
    numbers = _DIGIT.search(plain) is not None
    spoken = numbers or not low.isdisjoint(_DIGIT_WORD) and sum(w.lower() in _DIGIT_WORD for w in words) >= 7
    # All forms of an address but the English one need a figure, and that one needs a word for a street.
    streets_by = ([_STREET] if not low.isdisjoint(_STREET_WORD) else []) + ([_RUE, _CALLE, _STRASSE, _BOX] if numbers else [])
    named = _TWO_CAPITALS.search(plain) is not None or not low.isdisjoint(_PARTICLES) or any(names.family_vote(w) for w in words) or any(names.family_vote(w[:-2] if w.endswith(("'s", "'S")) else w) for w in _WORD.findall(plain))
    return "@" in plain or "at" in low or "arroba" in low or "chez" in low, numbers, spoken, streets_by, named


def spans_of(text: str | None, names: Names) -> list[Span]:
    """All proposed spans of one text with their votes; places are those of the text as given."""
    if not text:
        return []
    plain, places = tidy(text)
    mailed, numbers, spoken, streets_by, named = _possible(plain, names)
    out: list[Span] = []
    emails = list(_emails(plain)) if mailed else []
    covered = [(s, e) for s, e, _ in emails]
    found = [("email", x) for x in emails]
    ids = list(_ids(plain)) if numbers else []
    masked = plain
    for start, end, votes in ids:
        if votes[0] > 0 and votes[1] >= 0:
            masked = masked[:start] + "|" * (end - start) + masked[end:]
    streets = list(_streets(masked, streets_by))
    people = masked
    for start, end, votes in streets:
        if votes[0] > 0 and votes[1] >= 0:
            people = people[:start] + "|" * (end - start) + people[end:]
    for kind, spans in (("phone", _phones(masked) if spoken else ()), ("id_number", ids), ("street_address", streets), ("person_name", _people(people, names) if named else ())):
        found += [(kind, x) for x in spans if not any(s < x[1] and x[0] < e for s, e in covered)]
    for kind, (start, end, votes) in found:
        whole = (start, end) if places is None else (places[start], places[end - 1] + 1)
        out.append(Span(kind, *whole, votes, _context(plain, start, end)))
    return out


# ---------------------------------------------------------------- learning


def labeler_posteriors(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability that a span with each vote pattern is true.

    Two-class latent model: each labeler abstains, agrees or disagrees with its own rate in either class; the
    rates are estimated by expectation-maximisation from the counts of the patterns, starting from the majority.
    """
    total = counts.sum()
    post = 1 / (1 + np.exp(-1.5 * patterns.sum(1)))
    for _ in range(EM_ROUNDS):
        weight = np.stack([(1 - post) * counts, post * counts])
        prior = np.clip(weight.sum(1) / total, 0.02, 0.98)
        score = np.tile(np.log(prior)[:, None], (1, len(counts)))
        for j in range(patterns.shape[1]):
            rates = np.stack([[w[patterns[:, j] == v].sum() for v in (-1, 0, 1)] for w in weight])
            # A labeler is believed to be better than chance: pseudo counts on the side it is meant for.
            rates = rates + total * 0.02 * np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])
            rates = rates / rates.sum(1, keepdims=True)
            score += np.log(rates[:, patterns[:, j] + 1])
        post = 1 / (1 + np.exp(np.clip(score[0] - score[1], -30, 30)))
    return post


def _features(votes: np.ndarray, context: list[list[str]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and columns of the ones in the matrix of features, and its width: the votes and the hashed context."""
    k = votes.shape[1]
    base = 1 + 2 * k
    rows, cols = [np.arange(len(votes))], [np.zeros(len(votes), np.int64)]
    for first, cast in ((1, votes > 0), (1 + k, votes < 0)):
        r, c = np.nonzero(cast)
        rows.append(r)
        cols.append(c + first)
    rows.append(np.repeat(np.arange(len(votes)), [len(set(tags)) for tags in context]))
    cols.append(np.fromiter((base + zlib.crc32(tag.encode("utf-8", "surrogatepass")) % CONTEXT_BUCKETS for tags in context for tag in set(tags)), np.int64))
    return np.concatenate(rows), np.concatenate(cols), base + CONTEXT_BUCKETS


def probability(weights: np.ndarray, votes: np.ndarray, context: list[list[str]]) -> np.ndarray:
    rows, cols, _ = _features(votes, context)
    return 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights[cols], len(votes)), -30, 30)))


def train_classifier(votes: np.ndarray, context: list[list[str]], targets: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient descent until the gradient is small."""
    rows, cols, width = _features(votes, context)
    decay = np.full(width, 1e-3)
    decay[1 + 2 * votes.shape[1] :] = 4e-3
    w = ahead = np.zeros(width)
    n, step = len(votes), 4.0 / (1 + 2 * votes.shape[1] + 12)
    for k in range(FIT_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, ahead[cols], n), -30, 30)))
        slope = np.bincount(cols, (p - targets)[rows], width) / n + decay * ahead
        if np.abs(slope).max() < FIT_GRADIENT:
            break
        moved = ahead - step * slope
        ahead = moved + k / (k + 3) * (moved - w)
        w = moved
    return w


_SPANS = "kinds array<string>, starts array<bigint>, ends array<bigint>, votes array<array<tinyint>>, context array<array<string>>"


def _propose(names_of, keep: bool):
    """One row for each text with its proposed spans; without ``keep`` only texts that have some, and not the text itself."""
    kinds = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int8())), pa.list_(pa.list_(pa.string())))
    schema = [part.split()[0] for part in _SPANS.split(", ")]

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            own = [names_of.value] * len(texts)
            if batch.num_columns > 2:
                own = [names_of.value.only(f or [], g or []) for f, g in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            found = [spans_of(text, n) for text, n in zip(texts, own)]
            rows = range(len(texts)) if keep else [i for i, spans in enumerate(found) if spans]
            of = lambda part: [[part(s) for s in found[i]] for i in rows]
            columns = (of(lambda s: s.kind), of(lambda s: s.start), of(lambda s: s.end), of(lambda s: list(s.votes)), of(lambda s: s.context))
            at = pa.array(rows, pa.int64())
            text = batch.column(1).take(at) if keep else pa.nulls(len(at), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), text, *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["id", "text", *schema])

    return propose


def _gazetteer(df: DataFrame, texts: DataFrame, person_names: DataFrame) -> tuple[Names, DataFrame]:
    """The names for the tasks, and ``texts(id, text)``, with the names that stand in each where the gazetteer is large."""
    named = person_names.select("name_text", "name_kind").filter("name_text is not null")
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("w")).groupBy("w").count()
    ordinary = [r.w for r in words.orderBy(F.desc("count"), "w").limit(ORDINARY_WORDS).collect()]
    if named.limit(MAX_NAMES + 1).count() <= MAX_NAMES:
        return Names.of([tuple(r) for r in named.collect()], ordinary), texts

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(map(fold, batch.column(0).to_pylist())), pa.string()), batch.column(1)], ["name", "name_kind"])

    named = materialize(in_arrow(named, folded, "name string, name_kind string").filter("name <> ''").distinct(), "names")
    ends = [F.concat(F.lit("^"), F.substring("name", 1, k)) for k in (2, 3)] + [F.concat(F.substring(F.col("name"), -F.lit(k), F.lit(k)), F.lit("$")) for k in (2, 3, 4)]
    # Beginnings and ends of names are few, whatever the number of names.
    shapes = named.select("name_kind", F.explode(F.array(*ends)).alias("f")).groupBy("name_kind", "f").count().filter("count > 1").collect()
    counts = [Counter({r.f: r["count"] for r in shapes if r.name_kind == k}) for k in ("family", "given")]
    sizes = {r.name_kind: r["count"] for r in named.groupBy("name_kind").count().collect()}
    # A name is looked up by its first word.
    first = named.withColumn("w", F.split("name", "[ '-]")[0])
    rows = materialize(texts.select(F.monotonically_increasing_id().alias("row"), "*"), "texts")
    spoken = rows.select("row", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{M}]+"))).alias("w"))
    of = lambda kind: F.collect_set(F.when(F.col("name_kind") == kind, F.col("name")))
    standing = spoken.join(first, "w").groupBy("row").agg(of("family").alias("family"), of("given").alias("given"))
    return Names().shaped(counts, [sizes.get("family", 0), sizes.get("given", 0)], ordinary), rows.join(standing, "row", "left").drop("row")


def _judged(df: DataFrame, person_names: DataFrame, id_col: str, text_col: str, threshold: float, keep: bool) -> DataFrame:
    """``id, text, places``: the places of each text in order, none overlapping another."""
    spark = df.sparkSession
    kind_sql = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    filled = texts.filter(F.col("text").isNotNull())
    gazetteer, filled = _gazetteer(df, filled, person_names)
    names = spark.sparkContext.broadcast(gazetteer)
    proposed = materialize(in_arrow(spread(filled), _propose(names, keep), f"id {kind_sql}, text string, {_SPANS}"), "spans")
    spans = proposed.select("id", F.explode(F.arrays_zip("kinds", "starts", "votes", "context")).alias("s")).select("id", F.col("s.kinds").alias("kind"), F.col("s.starts").alias("start_pos"), "s.votes", "s.context")
    # Vote patterns of all spans: at most 3^5 for each kind.
    counted = spans.groupBy("kind", "votes").count().collect()
    models: dict[str, np.ndarray] = {}
    for kind in KINDS:
        own = [(tuple(r.votes), r["count"]) for r in counted if r.kind == kind]
        if not own:
            continue
        patterns, counts = np.array([v for v, _ in own]), np.array([c for _, c in own], float)
        posterior = dict(zip((v for v, _ in own), labeler_posteriors(patterns, counts)))
        sample = spans.filter(F.col("kind") == kind).orderBy(F.xxhash64("id", "start_pos", "context"), "id", "start_pos").limit(FIT_SPANS).select("votes", "context").collect()
        targets = np.array([posterior[tuple(r.votes)] for r in sample])
        models[kind] = train_classifier(np.array([r.votes for r in sample]), [r.context for r in sample], targets)
    weights = spark.sparkContext.broadcast(models)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, starts, ends, votes, context = (batch.column(i).to_pylist() for i in range(2, 7))
            flat = [(row, j) for row, spans in enumerate(kinds) for j in range(len(spans))]
            scores: dict[tuple[int, int], float] = {}
            for kind, w in weights.value.items():
                at = [(row, j) for row, j in flat if kinds[row][j] == kind]
                if at:
                    scores.update(zip(at, probability(w, np.array([votes[row][j] for row, j in at]), [context[row][j] for row, j in at])))
            places = []
            for row, spans in enumerate(kinds):
                # Of overlapping places the likelier, then the longer one.
                kept: list[tuple] = []
                for j in sorted((j for j in range(len(spans)) if scores[row, j] >= threshold), key=lambda j: (-scores[row, j], starts[row][j] - ends[row][j], starts[row][j], spans[j])):
                    if all(e <= starts[row][j] or ends[row][j] <= s for s, e, *_ in kept):
                        kept.append((starts[row][j], ends[row][j], spans[j], float(scores[row, j])))
                places.append([dict(zip(("start_pos", "end_pos", "pii_type", "score"), place)) for place in sorted(kept)])
            place = pa.struct([("start_pos", pa.int64()), ("end_pos", pa.int64()), ("pii_type", pa.string()), ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.list_(place))], ["id", "text", "places"])

    schema = f"id {kind_sql}, text string, places array<struct<start_pos:bigint,end_pos:bigint,pii_type:string,score:double>>"
    judged = in_arrow(proposed, judge, schema)
    if keep:
        nothing = F.array().cast("array<struct<start_pos:bigint,end_pos:bigint,pii_type:string,score:double>>")
        judged = judged.unionByName(texts.filter(F.col("text").isNull()).withColumn("places", nothing))
    return judged


def find_spans(df: DataFrame, person_names: DataFrame, *, id_col: str = "turn_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col, pii_type, start_pos, end_pos, score`` of every place of personal information.

    Positions count code points of the text as it is.  Null and empty texts have none; rows with the same id are one
    record, whose places (those of each of its texts, if they differ) are given once; places of rows with a null id
    are given with a null id; of overlapping places of a text the likelier, then the longer one is kept.  An empty
    gazetteer leaves the other labelers to decide.
    """
    judged = _judged(df, person_names, id_col, text_col, threshold, keep=False)
    places = judged.select(F.col("id").alias(id_col), F.inline("places"))
    return places.groupBy(id_col, "pii_type", "start_pos", "end_pos").agg(F.max("score").alias("score"))


def redact(df: DataFrame, person_names: DataFrame, *, id_col: str = "turn_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col, text``: each row's text with its places replaced by ``[TYPE]``, otherwise unchanged.

    Every row is redacted by its own text, whatever its id: also rows with a null id, and rows of one id whose texts
    differ.  A null text stays null.
    """
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    text = F.col("text")

    def step(acc, x):
        piece = F.substring(text, acc["at"].cast("int") + 1, (x["start_pos"] - acc["at"]).cast("int"))
        return F.struct(F.concat(acc["out"], piece, F.lit("["), F.upper(x["pii_type"]), F.lit("]")).alias("out"), x["end_pos"].alias("at"))

    done = F.aggregate("places", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    judged = _judged(df, person_names, id_col, text_col, threshold, keep=True)
    return judged.select(F.col("id").alias(id_col), F.when(F.size("places") > 0, done).otherwise(text).alias("text"))
