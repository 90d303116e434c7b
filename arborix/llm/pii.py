"""Personal information in free text, by anchor expansion.

An Aho-Corasick automaton over the lower-cased text finds anchors: at-signs and their spellings, number prefixes, cues of
identity documents and telephones, street words, given names, phrases that introduce a person and verbs that only a person
is the subject of. Around each anchor a deterministic parser expands to the borders of the value, word by word and without
a window of characters, and checks its form. A number without a cue counts only if its form is unmistakable or its check
digit holds; after a cue it counts as it stands, since reserved and misspelt numbers are no less personal.
Where values overlap, the order is email, identity number, phone, address, name; of one type the longer.
"""

from __future__ import annotations

import re
from bisect import bisect
from functools import lru_cache

import ahocorasick

from arborix.llm.given_names import GIVEN

TYPES = ("email", "id_number", "phone", "street_address", "person_name")
PLACEHOLDERS = {t: f"[{t.upper()}]" for t in TYPES}

# Words that introduce or follow what is sought.
AT = ("@", "[at]", "(at)", "{at}", " at ", "＠")
ID_CUES = (
    "ssn", "social security", "passport", "passeport", "pasaporte", "passaporte", "reisepass", "identity card", "id card", "id-card", "carte d'identité", "personalausweis", "ausweis", "steuer-id", "steuernummer", "dni", "nie", "nir",
    "sécurité sociale", "seguridad social", "national insurance", "ni number", "nino", "id number", "tax id", "tax number", "tin", "nif", "cpf", "codice fiscale", "insurance number", "social insurance", "driver's licence", "driver's license", "driving licence", "身份证", "護照", "护照", "マイナンバー",
)
PHONE_CUES = ("phone", "mobile", "fax", "tel", "tél", "t ", "call ", "number", "電話", "电话", "handy", "unter ", "appeler", "llam", "ligue", "móvil")
PHONE_PREFIXES = ("+", "(0", "(2", "(3", "(4", "(5", "(6", "(7", "(8", "(9", "0044", "0049", "0033", "020 ", "030/", "01.")
STREETS = (" road", " rd", " street", " st.", " lane", " drive", " close", " avenue", " terrace", " court", " crescent", " square", " sq", " place", " way", " gardens", " hill", " row")
STREETS_FIRST = ("rue ", "avenue ", "boulevard ", "impasse ", "chemin ", "allée ", "quai ", "place ", "calle ", "c/ ", "avenida ", "avda", "plaza ", "paseo ", "camino ", "rua ", "travessa ", "largo ", "praça ", "alameda ")
STREETS_JOINED = ("straße", "strasse", "str.", "weg", "platz", "gasse", "allee", "ufer", "damm", "ring", "hof", "am ", "an der ", "im ", "zum ", "zur ")
#: What is done to a sheet by somebody, in five languages, with the word that leads to the doer.
ACTS = (
    ("by ", "checked reviewed written signed approved reported submitted prepared requested sent filed entered edited curated annotated verified authored collected drafted compiled completed recorded supplied typed corrected proposed translated countersigned"),
    ("par ", "vérifié vérifiée relu relue écrit écrite signé signée approuvé signalé envoyé préparé rédigé corrigé annoté validé saisi"),
    ("von ", "geprüft geschrieben unterschrieben unterzeichnet genehmigt gemeldet gesendet erstellt verfasst bearbeitet kontrolliert freigegeben annotiert korrigiert"),
    ("por ", "revisado revisada escrito escrita firmado firmada aprobado enviado preparado redactado corregido anotado comprobado revisto revista assinado assinada aprovado redigido corrigido verificado"),
)
#: Phrases right before a person: titles, closings, openings, labels.
NAME_CUES = (
    *(f"{act} {to}" for to, acts in ACTS for act in acts.split()),
    "signed, ", "thanks to ", "cc ", "cc: ", "attn: ", "attn ", "dear ", "regards, ", "sincerely, ", "yours, ", "best, ", "cheers, ", "on behalf of ", "--\n", "regards,\n", "sincerely,\n", "yours,\n", "best,\n",
    "dr ", "dr. ", "mr ", "mr. ", "ms ", "ms. ", "mrs ", "mrs. ", "prof ", "prof. ", "merci à ", "merci à m. ", "merci à mme ", "mme ", "monsieur ", "madame ", "cordialement, ", "bonjour ", "an frau ", "an herrn ", "frau ", "herr ", "herrn ", "gruß, ", "grüße, ", "grüßen, ", "sehr geehrte frau ",
    "sehr geehrter herr ", "atentamente, ", "saludos, ", "sr. ", "sra. ", "señor ", "señora ", "estimado ", "estimada ", "gracias a ", "obrigado, ", "obrigada, ", "obrigado a ", "senhor ", "senhora ", "审核人：", "请联系 ", "联系人：", "担当：", "確認者は ", "氏名：", "姓名：",
    *(f"{label}: " for label in ("contact", "author", "curator", "reviewer", "patient", "applicant", "name", "owner", "signatory", "recipient", "sender", "editor", "auteur", "nom", "autor", "nombre", "nome", "bearbeiter", "ansprechpartner")),
)
#: Words that name a person's part in a table: the cell beside one, or those below it.
PERSON_HEADS = ("curator", "reviewer", "author", "contact", "applicant", "patient", "owner", "name", "full name", "editor", "signatory", "annotator")
#: What only a person is the subject of.
NAME_FOLLOWERS = tuple(
    f" {verb}"
    for verb in (
        "asked,asks,said,says,wrote,writes,replied,agreed,agrees,disagreed,disagrees,thinks,thought,told,called,emailed,phoned,lives,works,joined,complained,apologised,apologized,thanked,explained,insisted,promised,confirmed,suggested,wants,wanted,resigned,retired,moved to,is on leave,"
        "a demandé,a écrit,a répondu,a dit,habite,travaille,pense que,fragte,schrieb,antwortete,sagte,wohnt,arbeitet,meint,bat um,preguntó,escribió,respondió,dijo,vive en,trabaja,perguntou,escreveu,respondeu,disse,mora em,trabalha,です,さん,先生"
    ).split(",")
) + ("; no reply", "さん", "先生", "氏")
#: A name before one of these is that of a thing.
THINGS = re.compile(r"[\s-]+(?i:index|test|method|score|statistic|model|criterion|prize|award|institute|lab|street|road|database|algorithm|correction|plot|transform|buffer|medium|cell|line|strain|university|library|foundation|archive|protocol|scale)\b")
#: Numbers after one of these are those of things.
NOT_PERSONAL = re.compile(r"(?i:build|index|sample|barcode|checksum|accession|interval|plate|key|version|release|lot|order|catalog(?:ue)?|batch|scaffold|from)\s+\Z")

G = r"[ \u00a0\u2009\u202f]"  # a gap inside a number
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT|punkt|punto|ponto|point)\s?[\])}]\s?|\sDOT\s)"
_DOMAIN = rf"(?:{_LABEL}{_DOT})+[A-Za-z]{{2,24}}(?![A-Za-z0-9]|-[A-Za-z0-9])"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+'-") | {chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)}
LOCAL_FIRST, LOCAL_LAST = LOCAL - set("._%+'-"), LOCAL - set(".%'")
EMAIL_RIGHT = re.compile(_DOMAIN)
SPELLED_AT = re.compile(r"\s?(?:[\[({]\s?(?:at|AT)\s?[\])}]|AT)\s?|\s?[@＠]\s?")

PHONE = re.compile(
    rf"""(?:
      \+1{G}?\(\d{{3}}\){G}?\d{{3}}[-. ]\d{{4}} | \+1[-. ]\d{{3}}[-. ]\d{{3}}[-. ]\d{{4}}
    | \(\d{{3}}\){G}?\d{{3}}[-. ]\d{{4}} | [2-9]\d{{2}}([-. ])\d{{3}}\1\d{{4}}
    | \+44{G}?\d{{2,4}}{G}?\d{{3,4}}{G}?\d{{4}} | \+33{G}?[1-9](?:{G}?\d{{2}}){{4}} | \+49{G}?\d{{2,4}}{G}?\d{{4,5}}{G}?\d{{3,4}} | \+1{G}?\d{{10}}
    | \+(?:\d{G}?){{9,13}}\d | \+\d{{1,3}}(?:[-. /]\d{{1,5}}){{2,6}} | \+\d{{1,3}}{G}?\(0?\){G}?\d{{1,4}}(?:[-. /]\d{{2,8}}){{1,4}}
    | 0044-\d{{2,4}}-\d{{3,4}}-\d{{4}} | 0044(?:{G}?\d){{10}} | 0049{G}?\d{{2,4}}{G}\d{{5}}{G}?-?\d{{3}} | 0033(?:{G}?\d){{9}}
    | \(0\)\d{{2,4}}{G}\d{{4,5}}[- ]\d{{2,4}} | 0\d{{2,4}}/\d{{6,8}} | 020{G}\d{{4}}{G}\d{{4}} | 0\d{{2}}{G}\d{{5}}[- ]\d{{3}} | 0[1-9](?:[. ]\d{{2}}){{4}} | 0[1-9]\d{{8}}
    )(?![\w/-]|\.\d)""",
    re.X,
)
ID = re.compile(
    r"""(?:
      \d{3}-\d{2}-\d{4} | \d{3}[ ]\d{2}[ ]\d{4} | [A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D] | X[YZ]\d{7} | [A-Z]{2}\d{3}[A-Z]\d{4} | \d{8}-?[A-Z] | [XYZ]-?\d{7}-?[A-Z]
    | [0-9][ ]\d{2}[ ]\d{2}[ ]\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{2} | \d{3}\.\d{3}\.\d{3}-\d{2} | [A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z] | \d{17}[\dXx] | [0-9]\d{12}(?:\d{2})? | \d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3} | \d{3}[ ]\d{3}[ ]\d{3} | \d{11}
    | [A-Z]{1,2}\d{6,8} | [CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{8} | \d{9}
    )(?![\w-])""",
    re.X,
)
#: The forms that show without a cue what they are: any area number, with a group and a serial other than zeros, and any two letters.
ID_ALONE = re.compile(r"(?:\d{3}([- ])(?!00)\d{2}\1(?!0000)\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{2}\d{7}|[A-Z]{2}\d{3}[A-Z]\d{4})(?![\w-])")
#: Forms that count without a cue where their check digit holds.
CHECKED = re.compile(r"(?<![\w.+@/-])(?:(?P<dni>[XYZ]?\d{7,8}-?[A-Z])|(?P<nir>[12](?: ?\d{2}){3} ?\d{3} ?\d{3} ?\d{2})|(?P<cpf>\d{3}\.\d{3}\.\d{3}-\d{2})|(?P<steuer>[1-9]\d \d{3} \d{3} \d{3})|(?P<cn>[1-9]\d{16}[\dX]))(?![\w-])")


def _digits(x: str) -> list[int]:
    return [int(c) for c in x if c.isdigit()]


def _dni(x: str) -> bool:
    """Spanish: the number modulo 23 names the letter; X, Y and Z in front of it stand for 0, 1 and 2."""
    n = x.replace("-", "")
    body = n[:-1].translate(str.maketrans("XYZ", "012"))
    return len(body) == 8 and "TRWAGMYFPDXBNJZSQVHLCKE"[int(body) % 23] == n[-1]


def _nir(x: str) -> bool:
    """French: the key is 97 less the number modulo 97."""
    n = "".join(map(str, _digits(x)))
    return len(n) == 15 and 97 - int(n[:13]) % 97 == int(n[13:])


def _cpf(x: str) -> bool:
    """Brazilian: two weighted sums modulo 11."""
    n = _digits(x)
    check = lambda k: sum(v * (k + 1 - i) for i, v in enumerate(n[:k])) * 10 % 11 % 10
    return len(set(n)) > 1 and (check(9), check(10)) == (n[9], n[10])


def _steuer(x: str) -> bool:
    """German: the product method modulo 11, 10."""
    n, p = _digits(x), 10
    for v in n[:10]:
        p = ((p + v) % 10 or 10) * 2 % 11
    return (11 - p) % 10 == n[10]


def _cn(x: str) -> bool:
    """Chinese: powers of two modulo 11, 10 written as X."""
    return "10X98765432"[sum(int(c) * (2 ** (17 - i) % 11) for i, c in enumerate(x[:17])) % 11] == x[17]


CHECKS = {"dni": _dni, "nir": _nir, "cpf": _cpf, "steuer": _steuer, "cn": _cn}
#: A North American number without a cue: area and exchange begin with 2 to 9 and neither ends in 11.
PHONE_ALONE = re.compile(r"(?<![\w.+@/-])[2-9](?!11)\d{2}([-. ])[2-9](?!11)\d{2}\1\d{4}(?![\w/-]|\.\d)")
ID_START = re.compile(r"(?<![\w.+@/-])(?=\d{3}[- ]\d\d[- ]\d|[A-Z]{2} ?\d{2})")
#: Up to three words between a telephone cue and its number.
TO_NUMBER = re.compile(r"[^\s\d+(]*+(?:[ \t\xa0]++[^\s\d+(]++){0,3}+[ \t\xa0]*+(?=[+(\d])")
#: Ten digits after a word that can only mean a telephone.
PHONE_DIGITS = re.compile(r"[2-9](?!11)\d{2}[2-9](?!11)\d{6}(?![\w/-]|\.\d)")
PHONE_ONLY = ("phone", "mobile", "fax", "tel", "tél", "call ", "handy", "móvil", "電話", "电话")

_UP = r"[A-ZÀ-ÖØ-Þ]"
_WORD = rf"{_UP}[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w])"
STREET_LEFT = re.compile(rf"(?<![\w.,:/+-])\d{{1,4}}[A-Za-z]?,?\s(?:(?:{_WORD}|St\.|of|the)\s){{0,4}}(?:{_WORD}|St\.?)\Z")
FRENCH_LEFT = re.compile(r"(?<![\w.:/+-])\d{1,4}(?: ?(?:bis|ter|quater)|[a-zA-Z])?,?\s\Z")
LABELLED = re.compile(r"(?i:address|at|to|desk|in):?")
_LINK = r"(?:(?:du|des|de la|de l['’]|d['’]|de|del|de los|de las|la|le|los|las|do|da|dos|das|et|y|e) ?)"
FRENCH_RIGHT = re.compile(rf"(?:rue|avenue|boulevard|impasse|chemin|allée|quai|place) (?:{_LINK} ?)*{_WORD}")
FRENCH_MORE = re.compile(rf" (?:{_LINK})?({_WORD})")
SPANISH = re.compile(rf"(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Rua|Travessa|Largo|Praça|Alameda) (?:{_LINK} ?)*{_WORD}(?: (?:{_LINK} ?)*{_WORD})*,?\s(?:n[.ºo°]{{1,2}} ?)?\d{{1,4}}[a-zA-Z]?(?!\w)")
GERMAN_ADJECTIVE = re.compile(r"([A-ZÄÖÜ][a-zäöüß]+r)\s\Z")
GERMAN_NUMBER = re.compile(r"\s\d{1,4}[a-zA-Z]?(?!\w)")
GERMAN_PREP = re.compile(rf"(?:Am|An der|Im|Zum|Zur) (?:{_UP}[\w-]+ ){{1,3}}\d{{1,4}}[a-zA-Z]?(?!\w)")
#: Words that open a sentence and so are no part of a street's name that stands before them.
OPENERS = frozenset(
    "The It In On At Of For With When If Since Both Each Every Some No One Two This That These Those Please See Set After Before Until Under Without Within Should Is Are Was Were Which What Where Who Why How Nobody We They "
    "Call Write Send Questions Use Old Dr Mr Ms Mrs Prof Signed Contact Thanks Cordialement Atentamente Obrigado Obrigada Gruß Merci".split()
)
COPULA = re.compile(r" (?:is|was|est|está|ist|fica)\b")
#: Words before a German street that are no part of it.
STOP_LEFT = ("In", "Der", "Die", "Das", "Den", "Dem", "Adresse", "Anschrift", "Le", "La", "Ship", "Address", "At", "To")

_PARTICLE = r"(?:van\sder|van\sden|van\sde|van|von\sder|von\sdem|von|de\sla|de\slos|de\slas|de\sl['’]|del|de|da|dos|das|di|ter|ten)"
_FAMILY = rf"(?:{_PARTICLE}\s)?(?:[OD]['’]|Mc-?|Mac-?|MC-?)?{_UP}[^\W\d_]+(?:[-’'][^\W\d_]+)*"
_INITIAL = rf"{_UP}\."
_OPENER = "(?:" + "|".join(sorted(OPENERS)) + r")\b"
_GIVENNAME = "(?:" + "|".join(sorted(map(re.escape, GIVEN), key=len, reverse=True)) + ")"
_KNOWN = rf"(?i:{_GIVENNAME})(?![\w-])"
_ANYGIVEN = rf"(?!{_OPENER}){_UP}[^\W\d_]+(?:-{_UP}[^\W\d_]+)?"
NAME_KNOWN = re.compile(rf"{_KNOWN}(?:\s(?:{_KNOWN}|{_INITIAL})){{0,3}}\s{_FAMILY}(?![\w@])")
NAME_AFTER = re.compile(rf"{_FAMILY},\s(?:{_KNOWN}|{_INITIAL})(?:\s(?:{_KNOWN}|{_INITIAL}))*|(?:{_INITIAL}\s){{1,3}}(?:{_KNOWN}\s)?{_FAMILY}(?![\w@])|{_KNOWN}(?:\s(?:{_KNOWN}|{_INITIAL})){{0,3}}\s{_FAMILY}(?![\w@])")
_SHAPE = rf"{_ANYGIVEN}(?:\s(?:{_ANYGIVEN}|{_INITIAL})){{0,2}}\s(?!{_OPENER}){_FAMILY}"
NAME_SHAPE = re.compile(rf"{_SHAPE}(?=[;,.:)\]\"\t\n]|\s(?!{_UP})|\s{_OPENER}|\Z)")
TITLE = re.compile(r"(?:Dr|Prof|Mr|Ms|Mrs|Frau|Herrn?|M|Mme|DR)\.?\s")
NAME_BACK = re.compile(rf"(?:{_FAMILY},\s)?(?:(?:{_KNOWN}|{_INITIAL})\s){{0,4}}\Z")
BEFORE_FOLLOWER = re.compile(rf"(?:{_FAMILY},\s(?:{_KNOWN}|{_INITIAL})(?:\s(?:{_KNOWN}|{_INITIAL}))*|(?:(?:{_KNOWN}|{_INITIAL})\s){{1,4}}{_FAMILY})\Z")
SHAPE_BEFORE = re.compile(rf"{_ANYGIVEN}\s(?:{_INITIAL}\s)?(?!{_OPENER}){_FAMILY}\Z")
NAME_CELL = re.compile(rf"(?:{_FAMILY},\s(?:{_ANYGIVEN}|{_INITIAL})(?:\s(?:{_ANYGIVEN}|{_INITIAL}))*|(?:(?:{_ANYGIVEN}|{_INITIAL})\s){{1,4}}{_FAMILY})(?=[\t\n\"]|\Z)")
CELL = re.compile(r"[^\t\n]*+")


@lru_cache(maxsize=1)
def automaton():
    a = ahocorasick.Automaton()
    kinds: dict[str, set[str]] = {}
    for kind, words in (
        ("at", AT), ("id_cue", ID_CUES), ("phone_cue", PHONE_CUES), ("phone", PHONE_PREFIXES), ("street", STREETS), ("street_first", STREETS_FIRST), ("street_joined", STREETS_JOINED),
        ("given", GIVEN), ("name_cue", NAME_CUES), ("follower", NAME_FOLLOWERS), ("head", PERSON_HEADS),
    ):
        for w in words:
            kinds.setdefault(w, set()).add(kind)
    for w, k in kinds.items():
        a.add_word(w, (len(w), tuple(sorted(k))))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    """Lower case, one character for each of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


class Scan:
    """The values of one text. Expansion to the left goes word by word, as far as a form has words, however long they are."""

    def __init__(self, text: str):
        self.text = text
        self.spans: set[tuple[int, int, str]] = set()
        self.introduced = 0  # where the last phrase that introduces a person ends; no name begins before it

    def add(self, a: int, b: int, kind: str) -> None:
        if b > a:
            self.spans.add((a, b, kind))

    def before(self, at: int, words: int) -> list[int]:
        """Where the last words before a place begin, the nearest first; signs of scripts without spaces end one."""
        t, out, p = self.text, [], at
        for _ in range(words):
            while p and t[p - 1].isspace():
                p -= 1
            if not p:
                break
            while p and not t[p - 1].isspace() and t[p - 1] < "⿿":
                p -= 1
            out.append(p)
        return out

    def said(self, at: int) -> str:
        """The word before a place and the space behind it."""
        starts = self.before(at, 1)
        return self.text[starts[0] : at] if starts else ""

    def at(self, a: int, b: int) -> None:
        t = self.text
        lo = max(0, a - 2)
        m = next((m for p in range(lo, a + 1) if (m := SPELLED_AT.match(t, p)) and m.end() >= b - (t[b - 1] == " ")), None)
        if not m or not (right := EMAIL_RIGHT.match(t, m.end())):
            return
        p = m.start()
        if not p or t[p - 1] not in LOCAL_LAST:
            return
        while p and t[p - 1] in LOCAL:
            p -= 1
        while p < m.start() and t[p] not in LOCAL_FIRST:
            p += 1
        self.add(p, right.end() if p < m.start() else 0, "email")

    def number(self, at: int, pattern: re.Pattern, kind: str, back: int = 0) -> int:
        """A number that begins at most ``back`` characters (those of its prefix) before; its end, or 0."""
        t = self.text
        for p in range(max(0, at - back), at + 1):
            if p and (t[p - 1].isalnum() and t[p - 1] < "⿿" or t[p - 1] in "-_./+@" and t[p] != "(" and not (t[p - 1] == "." and t[p] == "+")):
                continue
            if (m := pattern.match(t, p)) and m.end() > at and not NOT_PERSONAL.search(self.said(p)):
                self.add(p, m.end(), kind)
                return m.end()
        return 0

    def whole(self, a: int, b: int) -> bool:
        """Whether no letter or digit goes on at either end (scripts without spaces apart)."""
        t = self.text
        return not (a and t[a - 1].isalnum() and t[a - 1] < "⿿" and t[a] < "⿿" or b < len(t) and t[b].isalnum() and t[b] < "⿿" and t[b - 1].isalnum() and t[b - 1] < "⿿")

    def phone_cue(self, a: int, b: int) -> None:
        t = self.text
        m = TO_NUMBER.match(t, b)
        if m and (a == 0 or not t[a - 1].isalnum() or t[a] > "⿿") and not self.number(m.end(), PHONE, "phone") and t[a:b].lower() in PHONE_ONLY:
            self.number(m.end(), PHONE_DIGITS, "phone")

    def phone(self, a: int, b: int) -> None:
        self.number(a, PHONE, "phone", 4)

    def id_cue(self, a: int, b: int) -> None:
        """The first word with a digit, of the seven after the cue on its line, if it has the form of a number."""
        t = self.text
        if not self.whole(a, b):
            return
        p = b
        for _ in range(8):
            while p < len(t) and t[p] != "\n" and not t[p].isalnum():
                p += 1
            if p == len(t) or t[p] == "\n":
                return
            if "0" <= t[p] <= "9" or "A" <= t[p] <= "Z":
                if self.number(p, ID, "id_number"):
                    return
                if t[p].isdigit():
                    return
            while p < len(t) and t[p].isalnum():
                p += 1
                if t[p - 1] > "⿿":
                    break

    def alone(self) -> None:
        """Numbers whose shape alone, or shape and check digit, tells what they are."""
        for m in ID_START.finditer(self.text):
            self.number(m.start(), ID_ALONE, "id_number")
        for m in CHECKED.finditer(self.text):
            if CHECKS[m.lastgroup](m.group()) and not NOT_PERSONAL.search(self.said(m.start())):
                self.add(m.start(), m.end(), "id_number")
        for m in PHONE_ALONE.finditer(self.text):
            self.number(m.start(), PHONE, "phone")

    def street(self, a: int, b: int) -> None:
        t = self.text
        word = t[a + 1 : b]
        if not word[:1].isupper():
            return
        tail = b
        if b < len(t) and t[b] == "." and word in ("St", "Sq", "Rd", "Ave"):
            tail = b + 1
        elif b < len(t) and (t[b].isalnum() or t[b] == "_"):
            return
        for p in self.before(a, 7):
            if STREET_LEFT.match(t, p, a):
                if not word.isupper() or LABELLED.fullmatch(self.said(p).strip()):
                    self.add(p, tail, "street_address")
                return

    def street_first(self, a: int, b: int) -> None:
        t = self.text
        if a and t[a - 1].isalnum():
            return
        number = next((p for p in self.before(a, 2) if FRENCH_LEFT.match(t, p, a)), None)
        if number is not None:
            if right := FRENCH_RIGHT.match(t, a):
                self.add(number, self.french_end(right.end()), "street_address")
        elif m := SPANISH.match(t, a):
            self.add(a, m.end(), "street_address")

    def french_end(self, end: int) -> int:
        """Further capitalised words of the name; the last one isn't if a sentence goes on behind it."""
        t, last = self.text, end
        while (m := FRENCH_MORE.match(t, end)) and m.group(1) not in OPENERS and m.group(1).lower() not in GIVEN:
            last, end = end, m.end()
        goes_on = end > last and re.match(r" [a-zà-ÿ0-9]|'s", t[end : end + 4]) and not COPULA.match(t, end)
        return last if goes_on else end

    def street_joined(self, a: int, b: int) -> None:
        t = self.text
        if m := GERMAN_PREP.match(t, a):
            if not (a and t[a - 1].isalnum()):
                self.add(a, m.end(), "street_address")
            return
        number = GERMAN_NUMBER.match(t, b)
        if not number or t[b - 1] == " ":
            return
        p = a
        while p and (t[p - 1].isalpha() or t[p - 1] == "-"):
            p -= 1
        if p == a or not t[p].isupper():
            return
        while (q := self.before(p, 1)) and (m := GERMAN_ADJECTIVE.match(t, q[0], p)) and m.group(1) not in STOP_LEFT:
            p = q[0]  # an adjective, as in Grüner Zipfelplatz
        self.add(p, number.end(), "street_address")

    def name(self, m: re.Match | None) -> bool:
        if m and not THINGS.match(self.text, m.end()):
            self.add(m.start(), m.end(), "person_name")
            return True
        return False

    def given(self, a: int, b: int) -> None:
        t = self.text
        if a and (t[a - 1].isalnum() and t[a - 1] < "⿿" or t[a - 1] in "@._+-%") or b < len(t) and (t[b] in "@+_-%" or t[b].isalnum() and t[b] < "⿿"):
            return
        if not t[a].isupper():
            return
        for p in reversed(self.before(a, 5)):
            if not p < self.introduced <= a and NAME_BACK.match(t, p, a) and (m := NAME_AFTER.match(t, p)) and m.end() >= b:
                self.name(m)
                return
        if not ((m := NAME_AFTER.match(t, a)) and m.end() >= b and self.name(m)):
            self.name(NAME_KNOWN.match(t, a))

    def name_cue(self, a: int, b: int) -> None:
        t = self.text
        if a and t[a].isalnum() and t[a] < "⿿" and t[a - 1].isalnum() and t[a - 1] < "⿿":
            return
        said = self.introduced = b
        if m := TITLE.match(t, b):
            b = m.end()
        self.name(NAME_AFTER.match(t, b) or NAME_AFTER.match(t, said) or NAME_SHAPE.match(t, b))

    def follower(self, a: int, b: int) -> None:
        """A name that ends before a verb; the longest with a known given name or an initial, else two words of the right shape."""
        t = self.text
        if b < len(t) and t[b - 1].isalnum() and t[b - 1] < "⿿" and t[b].isalnum():
            return
        end = a
        while end and t[end - 1] == " ":
            end -= 1
        starts = [q for p in self.before(end, 6) if (q := self.opened(p)) < end and not TITLE.match(t, q)]
        for p in reversed(starts):
            if (m := BEFORE_FOLLOWER.match(t, p, end)) and self.name(m):
                return
        for p in starts:
            if (m := SHAPE_BEFORE.match(t, p, end)) and not m.group().isupper() and not self.goes_back(p):
                self.name(m)
                return

    def opened(self, p: int) -> int:
        """The place behind brackets and quotes."""
        t = self.text
        while p < len(t) and t[p] in "([{\"'*<>-«“":
            p += 1
        return p

    def goes_back(self, p: int) -> bool:
        """Whether the word before a place is capitalised too, so that more than a name stands here."""
        said = self.said(p)
        return bool(said) and said[:1].isupper() and said.rstrip()[-1:].isalnum() and said.strip() not in OPENERS

    def head(self, a: int, b: int) -> None:
        """A word for a person's part as a cell of a table or a key of JSON: the name is beside it or in the cells below."""
        t = self.text
        if t[b : b + 1] == '"' and a and t[a - 1] == '"':
            if m := re.compile(r'"\s*:\s*"').match(t, b):
                self.name(NAME_CELL.match(t, m.end()))
            return
        if a and (t[a - 1].isalnum() and t[a - 1] < "⿿" or t[a - 1] in "-_/.@+") or not (b == len(t) or t[b] in "\t\n"):
            return
        if t[b : b + 1] == "\t" and self.name(NAME_CELL.match(t, b + 1)):
            return
        line = t.rfind("\n", 0, a) + 1
        column, end = t.count("\t", line, a), t.find("\n", b)
        if not column and t[b : b + 1] != "\t":
            return
        while 0 <= end < len(t) - 1:
            p, n = end + 1, 0
            while n < column and (m := CELL.match(t, p)) and t[m.end() : m.end() + 1] == "\t":
                p, n = m.end() + 1, n + 1
            if n < column or not self.name(NAME_CELL.match(t, p)):
                return
            end = t.find("\n", p)

    def chain(self) -> None:
        """Cells beside a person or a phone: a phone after a name, a document number after a phone."""
        t = self.text
        for a, b, kind in list(self.spans):
            if kind == "person_name" and t[b : b + 1] == "\t" and (end := self.number(b + 1, PHONE, "phone")):
                b, kind = end, "phone"
            if kind == "phone" and t[b : b + 1] == "\t":
                self.number(b + 1, ID, "id_number")

    def settle(self) -> list[tuple[int, int, str]]:
        """The spans without overlaps, in order of place: of those that overlap, the first in the order of types, then the longer.

        What is taken is kept in order of place, so a span is compared with its two neighbours alone.
        """
        rank = {k: i for i, k in enumerate(TYPES)}
        out: list[tuple[int, int, str]] = []
        for span in sorted(self.spans, key=lambda s: (rank[s[2]], s[0] - s[1], s[0])):
            i = bisect(out, span)
            if not (i and out[i - 1][1] > span[0] or i < len(out) and out[i][0] < span[1]):
                out.insert(i, span)
        return out


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of each value, in order and without overlaps; null and empty texts have none."""
    if not text:
        return []
    scan = Scan(text)
    for end, (n, kinds) in automaton().iter(lowered(text)):
        for kind in kinds:
            getattr(scan, kind)(end + 1 - n, end + 1)
    scan.alone()
    scan.chain()
    return scan.settle()


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder in the place of each value."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])
