"""Personal information in free text: mentions by type, and texts with placeholders.

Regular expressions propose spans. Each proposal has a base score by its shape;
checksums (Luhn, mod 97, mod 11, and letters of national ids) confirm it or count
against it, and context words near by raise or lower it. A span that reaches the
threshold is a mention. Spans are compared by score where they overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 1.0
#: Characters before and after a span in which context words count.
BEFORE, AFTER = 48, 28

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# Context words.
PHONE_WORDS = re.compile(
    r"(?i)\b(tel|phone|call|mobile|cell|fax|number is|reach|ring|rückruf|ruf|telefon|teléfono|teléfonos|appeler|téléphone|llamar|handy|escalation|hotline|whatsapp|on call|dial|sms|nummer|numéro|número|guardia)\b"
)
ID_WORDS = re.compile(
    r"(?i)\b(ssn|social security|tax id|tax number|tin|itin|steuer-?id|steuernummer|steuer-?identifikationsnummer|passport|reisepass|passeport|pasaporte|personalausweis|ausweis|national insurance|nino|ni number|dni|nie|nif|"
    r"national id|identity card|id card|carte d.identité|insee|nir|sécurité sociale|numéro de sécu|seguridad social|cédula|curp|cpf|codice fiscale|pesel|bsn|personnummer|iban|driver'?s licen[cs]e|führerschein)\b"
)
NOT_PERSONAL = re.compile(
    r"(?i)\b(build|commit|version|release|ports?|lines?|offset|weights?|request|trace|node|order|ticket|sha\d*|md5|checksum|hash|digest|took|ms|bytes?|uuid|pid|port|seconds|rows|units|invoice|issue|isbn|ean|sku|serial|zeile|lignes?|línea|version)\b"
)
HOME_WORDS = re.compile(r"(?i)(address|ship|deliver|device to|lives?|geht an|schicken|senden|liefern|zustellen|goes to|going to|return to|bound for|expédier|remettre|entregar|mandar|anschrift|adresse|livraison|dirección|domicilio|enviar|wohnt|envoyer|habite|mail to|send to|residence)")

# -- shapes -----------------------------------------------------------------------
_AT = r"(?:@|\s?(?:\(at\)|\[at\]|\{at\}|<at>|\(a\)|\[@\]|\(@\))\s?|\s(?i:at)\s)"
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\[\.\]|\(\.\))\s?|\s(?i:dot)\s)"
EMAIL = re.compile(
    r"(?<![\w.+%/@:\-])(?:mailto:)?(?P<local>[A-Za-z0-9À-ÿ](?:[\wÀ-ÿ.+%'\-]{0,62}[\w+])?)(?P<at>" + _AT + r")(?P<host>[A-Za-z0-9À-ÿ](?:[A-Za-z0-9À-ÿ\-]{0,62})?(?P<dots>(?:" + _DOT + r"[A-Za-z0-9À-ÿ](?:[A-Za-z0-9À-ÿ\-]{0,62})?){1,5}))(?P<tail>:?/?)"
)
MAILTO = re.compile(r"mailto:(?=[\w.+%\-]+@)")
# Accounts that are no persons.
ROLE_ACCOUNTS = frozenset("git svn hg root noreply no-reply donotreply postmaster mailer-daemon".split())

PHONE = re.compile(
    r"(?<![\w.+\-/:#@$%])(?<!\d )(?:"
    r"\+\d{1,3}(?:[ .\-/]?\(?\d{1,4}\)?){1,6}"
    r"|00[1-9]\d{0,2}(?:[ .\-/]\(?\d{1,4}\)?){2,6}"
    r"|\(\d{2,5}\)[ .\-]?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}"
    r"|0\d{1,4}(?:[ .\-/]\d{2,4}){2,4}|0\d{1,4}[ /\-]\d{5,8}"
    r"|\d{3}[ .\-]\d{3,4}[ .\-]\d{4}"
    r"|\d{9,12}"
    r")(?:\s?(?:ext|x|ext\.|durchwahl|poste)\.?\s?\d{1,5})?(?![\w/@]|[.\-]\d)"
)

_ID_SHAPES = [
    (0.55, r"\d{3}[- ]\d{2}[- ]\d{4}"),  # social security
    (0.9, r"[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]"),  # national insurance
    (0.4, r"\d{2} \d{3} \d{3} \d{3}"),  # tax id in groups
    (0.4, r"\d{2,3}/\d{3}/\d{4,5}"),  # tax number
    (0.9, r"[XYZ][- ]?\d{7}[- ]?[A-Z]"),  # foreigner's id
    (0.75, r"\d{8}[- ]?[A-HJ-NP-TV-Z]"),  # identity card with letter
    (0.3, r"[A-Z]\d{8}|[A-Z]{2}\d{7}|[CFGHJKLMNPRTVWXYZ][0-9CFGHJKLMNPRTVWXYZ]{8}|\d{2}[A-Z]{2}\d{5}"),  # passports and identity cards
    (0.85, r"[12] ?\d{2} ?(?:0[1-9]|1[0-2]|[2-9]\d) ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3}(?: ?\d{2})"),  # French social security
    (0.8, r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),  # bank account
    (0.8, r"[A-Z]{6}\d{2}[A-EHLMPR-T]\d{2}[A-Z]\d{3}[A-Z]"),  # Italian tax code
    (0.35, r"\d{11}"),
    (0.5, r"(?:\d[ \-]?){13,18}\d"),  # card numbers
]
ID_NUMBER = re.compile(r"(?<![\w.+\-/])(?:" + "|".join(f"(?P<s{i}>{p})" for i, (_, p) in enumerate(_ID_SHAPES)) + r")(?![\w\-]|/\d)")
#: After an unmistakable word any number-like token is an id. The longest there are, bank accounts, have 34 characters and 8 blanks.
ID_AFTER_WORD = re.compile(ID_WORDS.pattern + r"(?:\s*(?:no\.?|nr\.?|n°|nº|num(?:ber|éro|ero|mer)?\.?|#|id|is|ist|est|es|:|=|-|\"))*\s*[\"']?(?P<number>(?=[A-Z0-9\-/. ]*\d)[A-Z0-9](?:[A-Z0-9]|[ \-/.](?=[A-Z0-9]*\d|[A-Z]\b)){5,41})(?![a-z])")

_STREET_EN = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Terrace|Ter|Drive|Dr|Court|Ct|Way|Place|Pl|Crescent|Cres|Square|Sq|Boulevard|Blvd|Parkway|Pkwy|Grove|Gardens|Gdns|Row|Mews|Hill|Walk|Circle|Highway|Hwy)"
_CAP = r"[A-ZÀ-Þ][\wÀ-ÿ'’\-]+"
#: Forms that begin with the number, with the kind of street, and with the name of the street.
NUMBER_FIRST = re.compile(
    rf"[0-9](?<![\w.\-/:][0-9])[0-9]{{0,4}}(?:[A-Za-z]?,?\s+(?:{_CAP}\s+){{1,3}}(?:{_STREET_EN}|{_STREET_EN.upper()})\b\.?"
    r"|(?:\s?(?:bis|ter|quater|[A-Da-d]))?,?\s+(?i:rue|avenue|av\.|boulevard|bd|impasse|allée|chemin|place|quai|route|cours|passage|square|ruelle)\s+"
    r"(?:(?i:de la|de l['’]|des|du|de|d['’]|le|la|les)\s*)*[A-ZÀ-Þ][\wÀ-ÿ'’\-]+)"
)
UNIT_AT = re.compile(r"(?i:flat|apt|apartment|unit|suite|ste|floor)\b")
UNIT_BEFORE = re.compile(r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Ste\.?|Floor|FLAT|APT\.?|UNIT|SUITE|STE\.?)\s+#?\w{1,5}\s*,\s*\Z")
KIND_FIRST = re.compile(
    r"(?:Calle|calle|CALLE|C/|c/|Camino|camino|Carretera|carretera|Avenida|avenida|AVENIDA|Avda\.|avda\.|Av\.|av\.|Plaza|plaza|PLAZA|Paseo|paseo|PASEO|Pasaje|pasaje|Ronda|ronda|Travesía|travesía|Glorieta|glorieta)\s+(?:(?i:de la|de los|de las|del|de|el|la|las|los)\s+)*"
    r"[A-ZÀ-Þ][\wÀ-ÿ'’\-]+(?:\s+[A-ZÀ-Þ][\wÀ-ÿ'’\-]+)?,?\s+(?:n[º°.]?\s*)?\d{1,4}\b"
)
NAME_FIRST = re.compile(
    r"(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig|STRASSE|STRAßE|WEG|GASSE|PLATZ|ALLEE)\s+\d{1,4}\s?[a-zA-Z]?\b(?!\s*(?:%|ms|MB))"
)
WORD_BEFORE = re.compile(r"[A-ZÄÖÜ][\wäöüßÄÖÜ\-]*\Z")
#: A flat's number makes an address of a street and a number, wherever it stands.
UNIT_AFTER = re.compile(r"\s*,?\s*(?i:apt|apartment|flat|unit|suite|ste)\.?\s*#?\d\w*\b|\s*,\s*\d{1,2}\s?[º°ª]")
AFTER_ADDRESS = re.compile(r"\s*,?\s*(?:(?i:apt|flat|unit|suite)\.?\s*\w+\s*,?\s*|\d{1,2}\s?[º°ª]\s?\w?\s*,?\s*)?(?:\d{4,5}\s+[A-ZÀ-Þ]|[A-ZÀ-Þ][\wÀ-ÿ\-]+(?:[ \-][A-ZÀ-Þ\w][\wÀ-ÿ\-]*)*,?\s*\d{4,5}\b|[A-ZÀ-Þ][\wÀ-ÿ\-]+\s*[.\n]|[A-ZÀ-Þ][\wÀ-ÿ\-]+\Z)")

# Given names that are common in English, German, French and Spanish, a hint beside the context.
GIVEN = frozenset(
    """Adam Alan Albert Alejandro Alexander Alice Amanda Amy Ana Andrea Andreas Andrew Angela Anna Anne Anthony Antonio Arthur Barbara Beatriz
    Benjamin Brian Camille Carlos Carmen Carol Caroline Catherine Charles Charlotte Christian Christine Christopher Claire Clara Claudia Daniel
    David Deborah Diego Donald Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Felix Fernando Fiona Florian Frank Gabriel George Greta Gustav
    Hannah Hans Helen Henry Hugo Ingrid Isabel Jack James Jan Jane Javier Jean Jennifer Jessica Johannes John Jonas Jorge Jose Joseph Juan Julia
    Julie Karen Karl Katharina Kevin Klaus Laura Lea Lena Leo Leon Linda Lisa Louis Louise Lucas Lucia Luis Lukas Manuel Margaret Maria Marie
    Mark Markus Marta Martin Mary Matthew Max Melanie Michael Michelle Miguel Monika Nadia Nancy Nicolas Nicole Nina Olivia Oskar Pablo Patricia
    Patrick Paul Pedro Peter Petra Philip Pierre Rachel Rebecca Richard Robert Roberto Rosa Ruth Sabine Samuel Sandra Sara Sarah Sebastian Simon
    Sofia Sophie Stefan Stephanie Stephen Steven Susan Susanne Teresa Thomas Tobias Ursula Valentina Vera Victor Walter William Wolfgang""".split()
)
# Capitalised words that stand beside names or look like parts of them.
_NO_NAME = frozenset(
    """The This That These Those If When Where While Why How What Which Who Run Do Does Did Since See Each Every Any All No Not Nobody And Or But For From To With Without
    Tests Test Related Compared We He She They It In On At By Of As Is Are Was Given Expected Held Lines
    Router Query Planner Street Level View Main Data File Code Page Service System Server Client Team Owner Author Reported Reviewed Signed Contact Contacto Kontakt Call Ship
    Mailing Address Adresse Minutes Escalation Merci Thanks Revisado Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July
    August September October November December Siehe Wir Der Die Das Ein Eine Vor Ohne Nach Wenn Frau Herr Voir Nous Les Le La Une Un El Los Las Una Antes No Enviar Im Am Ticket
    Mr Mrs Ms Dr Prof Sr Sra Monsieur Madame Mme Note Todo Fixme Warning Error Info Debug Section Chapter Table Figure Appendix Key Value Sort Group Order Index Unit Load Cache Write
    Number My Hardware Rückfragen Rückruf Teléfono Report Summary Overview Next First Last Type Status Version Release Memory Learnings Pitfall Decision Architecture Workflow Convention""".split()
)
_N = r"[A-ZÀ-Þ](?:['’][A-ZÀ-Þ])?[a-zà-ÿß]+(?:[\-'’][A-ZÀ-Þ]?[a-zà-ÿß]+)*"
_PARTICLE = r"(?:(?:van|von|de|der|den|la|di|da|del|dos|bin|al|el|le|du|ter|ten|zu)\s+){0,2}"
#: Patterns that are run over whole texts begin with a plain class, so that the engine can skip to it; what must not precede it follows as a lookbehind.
FULL_NAME = re.compile(rf"[A-ZÀ-Þ](?<![\w@/.\-'’][A-ZÀ-Þ])(?:['’][A-ZÀ-Þ])?[a-zà-ÿß]+(?:[\-'’][A-ZÀ-Þ]?[a-zà-ÿß]+)*(?:\s+[A-Z]\.)?\s+{_PARTICLE}{_N}(?![\w@/]|\(|\.\w)")
TITLED = re.compile(rf"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Frau|Herr|Herrn|Hr|Fr|Sr|Sra|Don|Doña|Señor|Señora|Monsieur|Madame|Mme|Mlle|M)\b\.?\s+(?P<name>(?:(?:Dr|Prof)\.\s+)?(?:{_N}\s+)?{_PARTICLE}{_N})(?![\w(])")
REVERSED = re.compile(rf"(?<![\w@/.\-])(?P<name>{_PARTICLE}{_N},\s+{_N})(?=\s*(?:;|<|\(|$|\n|\r|\"|\||\s-\s))", re.M)
INITIAL = re.compile(rf"(?P<name>[A-ZÀ-Þ](?<![\w@/.\-][A-ZÀ-Þ])\.[ \-]?(?:[A-ZÀ-Þ]\.[ \-]?)?\s?{_PARTICLE}{_N})(?![\w(@])")
#: Words after which, or before which, a capitalised pair is a person.
BEFORE_NAME = re.compile(
    r"(?i)(?:\b(?:ask|asked|contact|contacto|kontakt|contacter|owner|author|autor|autora|auteur|verfasser|reported by|reviewed[- ]by|signed-off-by|co-authored-by|acked-by|tested-by|approved by|assigned to|assignee|on call|on-call|attendees|attendee|present|"
    r"participants|teilnehmer|asistentes|participantes|thanks to|thank|merci à|danke an|gracias a|revisado por|relu par|geprüft von|escrito por|cc|bcc|from|to|name|holder|user|customer|patient|employee|client|kunde|an|von|für|por|par|reach|ping|"
    r"call|meet|met|with|and|und|et|y|by|dear|hallo|hello|hi|bonjour|hola|sincerely|regards|grüße|cordialement|manager|lead|maintainer|reporter|responsable|encargado|zuständig|ansprechpartner)\b[\s:\"'=\[(*_|>-]*|[|\[,;]\s*|--\s*|^\s*[-*>]?\s*)\Z"
)
STRONG_BEFORE = re.compile(
    r"(?i)(?:\+?\(?\d[\d .()\-]{6,}\d(?:\s?ext\.?\s?\d+)?,\s*\Z)|\b(?:contact|contacto|kontakt|owner|author|autor|reported by|reviewed[- ]by|signed-off-by|co-authored-by|acked-by|tested-by|assignee|on call|attendees|participants|teilnehmer|asistentes|thanks to|merci à|danke an|gracias a|revisado por|relu par|"
    r"geprüft von|cc|bcc|from(?=\s*:)|holder|customer|patient|employee|ask|bitte an|wenden sie sich an|melden bei|maintainer|reporter|ansprechpartner|sincerely|regards)\b[\s:\"'=\[(*_|>-]*(?:\{?\s*name\s*[:=]\s*\"?)?\Z"
)
#: A label that begins its line or is followed by a colon: what comes next is a person, without another sign.
_LABELS = (
    r"contact|contacto|kontakt|contacter|owner|author|autor|autora|auteur|auteure|verfasser|verfasserin|reported by|reviewed[- ]by|signed-off-by|co-authored-by|acked-by|tested-by|approved[- ]by|assigned to|assignee|on call|on-call|attendees?|"
    r"participants?|participantes?|teilnehmer|teilnehmerin|asistentes?|thanks to|merci à|danke an|gracias a|revisado por|relu par|geprüft von|escrito por|cc|bcc|holder|user|usuario|utilisateur|benutzer|"
    r"customer|patient|employee|client|kunde|kundin|cliente|dear|hallo|hello|hi|bonjour|hola|sincerely|regards|grüße|cordialement|saludos|manager|lead|maintainer|reporter|responsable|encargado|encargada|zuständig|ansprechpartner|ansprechpartnerin|"
    r"genehmigt von|approuvé par|aprobado por|zugewiesen an|assigné à|asignado a|geschrieben von|écrit par|gemeldet von|signalé par|reportado por"
)
#: Words of mail heads, which need the begin of the line and a colon. ``name`` is no label of a person: configuration names things.
_HEAD_LABELS = "from|to|an|von|para|de|à|à l'attention de|für|por|par|by"
#: English nouns with which headings begin too need a colon.
_LINE_LABELS = "|".join(x for x in _LABELS.split("|") if x not in ("manager", "lead", "user", "client", "hi"))
_LINE_START = r"(?:^|(?<=\n))[ \t>*#|\-]*"
LABEL_BEFORE = re.compile(
    rf"(?i)(?:(?:(?<![\w\-])(?:{_LABELS})|{_LINE_START}(?:{_HEAD_LABELS}))[\"'*_)\]]*[ \t\u00a0\u202f]*:[\s\"'=\[(*_|>-]*|{_LINE_START}(?:{_LINE_LABELS})\b[*_]*[ \t]*,?[*_]*[ \t]*(?:\r?\n[ \t]*)?)\Z"
)
AFTER_NAME = re.compile(
    r"(?i)\s*(?:[<(\[]?[\w.+\-]+\s?(?:@|\(at\)|\[at\])|\]\(mailto:|\]?\(?\+?\d[\d .()\-]{6,}|\|\s*[+(\d]|,\s*(?:tel|phone|[\w.+\-]+\s?(?:@|\(at\)|\[at\]))|\(\(?[+\d]|\"?,?\s*\"?(?:mail|email|phone|doc|tel)\b|asked\b|noted\b|said\b|wrote\b|reported\b|"
    r"reviewed\b|owns\b|hat\b|lives\b|wohnt\b|called\b|agreed\b|suggested\b|and\s+[A-Z]|und\s+[A-Z]|,\s+[A-Z][a-z]+\s+[A-Z])"
)


@dataclass
class Span:
    start: int
    end: int
    kind: str
    score: float


# -- validators -------------------------------------------------------------------
def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Check digits of an international bank account number."""
    s = re.sub(r"\W", "", account).upper()
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{8,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def german_tax_id(digits: str) -> bool:
    if len(digits) != 11:
        return False
    product = 10
    for d in digits[:10]:
        s = (int(d) + product) % 10 or 10
        product = s * 2 % 11
    return (11 - product) % 10 == int(digits[10])


def spanish_letter(text: str) -> bool:
    s = re.sub(r"\W", "", text).upper()
    m = re.fullmatch(r"([XYZ]?)(\d{7,8})([A-Z])", s)
    return bool(m) and "TRWAGMYFPDXBNJZSQVHLCKE"[int({"X": "0", "Y": "1", "Z": "2", "": ""}[m[1]] + m[2]) % 23] == m[3]


def french_key(text: str) -> bool:
    s = re.sub(r"\D", "", text)
    return len(s) == 15 and 97 - int(s[:13]) % 97 == int(s[13:])


# -- proposals --------------------------------------------------------------------
def _context(pattern: re.Pattern, text: str, start: int, end: int) -> bool:
    a, b = max(0, start - BEFORE), min(len(text), end + AFTER)
    begin = text.rfind("\n", a, start)
    stop = text.find("\n", end, b)
    # The line of the span counts, and the end of the line before if the span begins its line.
    if begin >= 0 and text[begin + 1 : start].strip():
        a = begin + 1
    return bool(pattern.search(text, a, start)) or bool(pattern.search(text, end, b if stop < 0 else stop))


def _around(marks: re.Pattern, pattern: re.Pattern, text: str, before: int, after: int) -> Iterator[re.Match]:
    """Matches of a costly pattern near the places that a cheap one finds; each match once.

    What is searched are the whole lines around a mark: from the begin of its line, or
    ``before`` characters earlier, which reaches over a line break, to the end of the line in which
    ``after`` characters behind the mark lie. No line is searched twice.
    """
    done = covered = 0
    for mark in marks.finditer(text):
        if mark.start() < covered:
            continue
        line_end = text.find("\n", min(len(text), mark.end() + after))
        covered = len(text) if line_end < 0 else line_end
        begin = min(mark.start() - before, text.rfind("\n", done, mark.start()) + 1 or done)
        for m in pattern.finditer(text, max(done, begin), covered):
            done = m.end()
            yield m


_AT_SIGN = re.compile(r"@|[(\[{<]\s?(?i:at|a)\s?[)\]}>]|\s(?i:at)\s[\w\-]+(?:\.|\s(?i:dot)\s|\s?[(\[{<](?i:dot|\.)[)\]}>])")
_DIGITS = re.compile(r"[0-9](?:[ ./()\-]{0,2}[A-Z0-9]){3}")
_CAPITALS = re.compile(r"[A-Z][A-Z][A-Z][A-Z0-9]{0,12}[0-9]")
_LEAD = re.compile(r"\+?\(?(?:[A-Z]{1,6}[ \-]?)?[A-Z0-9]*\Z")


def numeric_marks(text: str) -> list[tuple[int, int]]:
    """Begin and end of what may be a number of any kind, with the letters that lead it."""
    marks = []
    for m in _DIGITS.finditer(text):
        lead = _LEAD.search(text, max(0, m.start() - 9), m.start())
        marks.append((lead.start() if lead else m.start(), m.end()))
    marks += [m.span() for m in _CAPITALS.finditer(text)]
    return sorted(marks)


_LONG_NUMBER = re.compile(r"[0-9](?:[ ./()\-]{0,3}\d){6}")
#: A name after a comma, before what can follow one.
_LAST_FIRST = re.compile(r",(?<=[a-zß-ÿ],)\s+[A-ZÀ-Þ][a-zß-ÿ][a-zß-ÿ\-'’]*\s*(?:[;<(\n\r|\"]|-|\Z)")


def emails(text: str) -> Iterator[Span]:
    for m in _around(_AT_SIGN, EMAIL, text, 80, 220):
        local, at, host = m["local"], m["at"], m["host"]
        spelled = "@" not in at and at.strip().lower() == "at"
        top = re.split(r"[^A-Za-zÀ-ÿ0-9\-]+", m["dots"].strip())[-1]
        score = 1.2
        if local.lower() in ROLE_ACCOUNTS or m["tail"].startswith(":") and re.match(r":[\w~./]", text[m.end("host") :]):
            score -= 1  # an address of a repository
        if not re.fullmatch(r"[A-Za-zÀ-ÿ]{2,}", top):
            score -= 1  # a package and its version
        if spelled and "." in m["dots"] and not re.search(r"[.+_\d]", local):
            score -= 0.6  # words of a sentence
        if re.search(r"://[^\s]*$", text[max(0, m.start() - 60) : m.start()]):
            score -= 0.8  # user and host of a URL
        start = m.start("local")
        yield Span(start, m.end("host"), "email", score)


def phones(text: str) -> Iterator[Span]:
    for m in _around(_LONG_NUMBER, PHONE, text, 24, 48):
        shape = m.group()
        while shape.count(")") > shape.count("(") and shape.endswith(")"):
            shape = shape[:-1]
        end = m.start() + len(shape)
        digits = re.sub(r"\D", "", re.split(r"(?i)\s?(?:ext|x|durchwahl|poste)", shape)[0])
        if not 7 <= len(digits) <= 15:
            continue
        if shape.startswith("+") and " " not in shape and len(digits) < 9:
            continue
        score = 0.95 if shape.startswith("+") and len(digits) >= 9 else 0.75 if shape.startswith("(") or shape.startswith("0") else 0.6
        if re.fullmatch(r"\d+", shape):
            score = 0.1
        if re.search(r"(?i)ext|durchwahl", shape):
            score += 0.5
        if re.fullmatch(r"\d{3}-\d{2}-\d{4}|\d{4}-\d{2}-\d{2}.*|\d{1,3}(?:\.\d{1,3}){3}", shape):
            score -= 1
        if shape.startswith("+") and re.search(r"(?i)(?:offset|delta|diff|by|utc|gmt)\s*$", text[max(0, m.start() - 10) : m.start()]):
            score -= 1
        if _context(PHONE_WORDS, text, m.start(), end):
            score += 0.5
        if not shape.startswith("+") and re.search(r"(?i)(?:build|commit|version|ports?|lines?|offset|request|trace|node|order|id|sha|hash|weights?|no\.|ssn|security number|ausweis)\W*$", text[max(0, m.start() - 24) : m.start()]):
            score -= 0.8
        if score < THRESHOLD and score > 0.5 and not re.fullmatch(r"\d+", shape) and (AROUND_PHONE.search(text, max(0, m.start() - 40), m.start()) or re.match(r"\s*\|", text[end : end + 3])):
            score += 0.4
        yield Span(m.start(), end, "phone", score)


#: A name, a mail address or a label directly before a number.
AROUND_PHONE = re.compile(rf"(?:{_N}\s+{_N}|@[\w.\-]+|phone\"?|tel\"?|mobile\"?)[\s|,:;=\"'(\[<\-]*\Z")


#: Every one of the id words contains one of these.
_ID_STEMS = ("ssn", "secur", "tax", "tin", "steuer", "pass", "ausweis", "insurance", "nino", "ni n", "dni", "nie", "nif", "national", "identi", "id card", "insee", "nir", "sécu", "segur", "dula", "curp", "cpf", "codice", "pesel", "bsn", "personnummer", "iban", "licen", "schein")


def _after_id_word(text: str, marks: list[tuple[int, int]]) -> Iterator[re.Match]:
    done = 0
    for begin, end in marks:
        start = max(done, begin - 64)
        before = text[start:begin].lower()
        if any(stem in before for stem in _ID_STEMS):
            m = ID_AFTER_WORD.search(text, start, min(len(text), end + 64))
            if m:
                done = m.end()
                yield m


_STARTS = re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]")


def _shaped(text: str, marks: list[tuple[int, int]]) -> Iterator[re.Match]:
    """Numbers in the shape of an id; each begins with a word of a numeric mark."""
    done = 0
    for begin, end in marks:
        if end <= done:
            continue
        for start in _STARTS.finditer(text, begin, end):
            m = ID_NUMBER.match(text, start.start()) if start.start() >= done else None
            if m:
                done = m.end()
                yield m


def id_numbers(text: str) -> Iterator[Span]:
    marks = numeric_marks(text)
    for m in _after_id_word(text, marks):
        number = m["number"].rstrip(" -/.")
        if sum(c.isdigit() for c in number) >= 4:
            yield Span(m.start("number"), m.start("number") + len(number), "id_number", 1.6)
    for m in _shaped(text, marks):
        i = int(m.lastgroup[1:])
        shape, score = m.group(), _ID_SHAPES[i][0]
        digits = re.sub(r"\D", "", shape)
        if i == 4 or i == 5:
            score += 0.3 if spanish_letter(shape) else -0.2
        elif i == 7:
            score += 0.3 if french_key(shape) else -0.6
        elif i == 8:
            score += 0.5 if mod97(shape) else -0.8
        elif i in (2, 10):
            score += 0.2 if german_tax_id(digits) else 0
        elif i == 11:
            score += 0.2 if luhn(digits) else -1
        if _context(ID_WORDS, text, m.start(), m.end()):
            score += 0.8
        elif _context(NOT_PERSONAL, text, m.start(), m.end()):
            score -= 0.6
        yield Span(m.start(), m.end(), "id_number", score)


def _address_spans(text: str) -> Iterator[tuple[int, int]]:
    for m in NUMBER_FIRST.finditer(text):
        unit = UNIT_BEFORE.search(text, max(0, m.start() - 24), m.start())
        yield (unit.start() if unit else m.start()), m.end()
    for m in KIND_FIRST.finditer(text):
        if not text[m.start() - 1 : m.start()].isalnum():
            yield m.span()
    for m in NAME_FIRST.finditer(text):
        word = WORD_BEFORE.search(text, max(text.rfind(" ", 0, m.start()), text.rfind("\n", 0, m.start())) + 1, m.start())
        if word and not re.fullmatch(r"(?i)hin|um|weg", word.group()):
            yield word.start(), m.end()


def addresses(text: str) -> Iterator[Span]:
    for start, end in _address_spans(text):
        score = 0.6
        after = AFTER_ADDRESS.match(text, end)
        if after:
            score += 0.5
        if _context(HOME_WORDS, text, start, end):
            score += 0.5
        if not text[start].isdigit() and UNIT_AT.match(text, start) or UNIT_AFTER.match(text, end):
            score += 0.5
        if not text[text.rfind("\n", 0, start) + 1 : start].strip(" \t>*-|"):
            score += 0.45  # it begins its line
        if "\n" in text[start:end].strip() and not after:
            score -= 0.3
        yield Span(start, end, "address", score)


def _plausible(name: str) -> bool:
    return not any(w.strip(".,").capitalize() in _NO_NAME for w in name.split() if w[:1].isupper())


def _uncommon(text: str, name: str) -> bool:
    """No part of the name stands in the text as an ordinary word."""
    return not any(re.search(rf"(?<!\w){re.escape(w.lower())}(?!\w)", text) for w in name.split() if w[:1].isupper())


def _labelled(text: str, start: int) -> bool:
    return bool(LABEL_BEFORE.search(text, max(0, start - 40), start))


#: What may stand between a person and where they live.
_LIVES = re.compile(r"\s*(?:,|;|:|\||-|–|\(|\n)?\s*(?:(?i:at|of|in|lives at|living at|wohnt in|wohnhaft in|wohnhaft|habite au|habite|demeurant|domiciliad[oa] en|vive en|in der)\s+)?\Z")


def names(text: str, places: list[Span] = ()) -> Iterator[Span]:
    """Proposals of names; ``places`` are the addresses of the text in order, for names that stand before one."""
    begins = [p.start for p in places]

    def lives(end: int) -> bool:
        i = bisect_left(begins, end)
        return i < len(begins) and begins[i] - end <= 24 and bool(_LIVES.match(text, end, begins[i]))

    for m in TITLED.finditer(text):
        title = m.group().split()[0].rstrip(".")
        if text[m.start() - 1 : m.start()].isalnum() and m.start():
            continue
        if title in ("M", "Fr", "Hr", "Don") and "." not in m.group()[:4]:
            continue
        if _plausible(m["name"]):
            yield Span(m.start("name"), m.end("name"), "name", 1.4)
    for m in _around(_LAST_FIRST, REVERSED, text, 40, 40):
        last, first = (x.strip() for x in m["name"].split(","))
        score = 0.4
        before = text[max(0, m.start() - 40) : m.start()]
        if first in GIVEN:
            score += 0.7
        if STRONG_BEFORE.search(before) or _labelled(text, m.start()):
            score += 0.6
        if _plausible(f"{last} {first}"):
            yield Span(m.start(), m.end("name"), "name", score)
    for m in INITIAL.finditer(text):
        before = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        score = 0.3
        if re.fullmatch(r"\s*(?:--|—|–|~|-)\s*", before):
            score += 0.8  # a signature
        if STRONG_BEFORE.search(before) or _labelled(text, m.start()):
            score += 0.8
        if AFTER_NAME.match(text, m.end()):
            score += 0.4
        if _plausible(m["name"]):
            yield Span(m.start(), m.end(), "name", score)
    for pattern, upper in ((FULL_NAME, False), (_UPPER_NAME, True)):
        at, last_end = 0, -1
        while True:
            m = pattern.search(text, at)
            if m is None:
                break
            words = m.group().split()
            # Pairs may overlap: a word that can't be a given name is left behind.
            at = m.start() + len(words[0])
            first, last = words[0], words[-1]
            if first.rstrip(".,") in _NO_NAME or last in _NO_NAME or not _plausible(m.group()):
                continue
            if "\n" in m.group() and re.search(r"\n\s*\n", m.group()):
                continue
            score = 0.3
            if (first.capitalize() if upper else first) in GIVEN:
                score += 0.8
            before = text[max(0, m.start() - 40) : m.start()]
            labelled = bool(STRONG_BEFORE.search(before)) or _labelled(text, m.start())
            if labelled or last_end >= 0 and m.start() - last_end < 12 and LISTED.fullmatch(text, last_end, m.start()):
                score += 0.8
            elif BEFORE_NAME.search(before):
                score += 0.25
            if AFTER_NAME.match(text, m.end()) or begins and lives(m.end()):
                score += 0.75
            if 0 < score < THRESHOLD and not upper and (DEED_AFTER.match(text, m.end()) or DEED_BEFORE.search(before)) and _uncommon(text, m.group()):
                score += 0.75
            if upper and (not labelled or m.start() - text.rfind("\n", 0, m.start()) > 26):
                score -= 1.0  # in capitals only where a label begins the line, not inside of a sentence in capitals
            if "\n" in m.group() and not labelled:
                score -= 1.0
            if score >= THRESHOLD:
                at = last_end = m.end()
                yield Span(m.start(), m.end(), "name", score)


#: What only persons do, before or after their name, in four languages.
DEED_AFTER = re.compile(
    r"\s+(?:(?:has|had|hat|a|ha|also|then|later|already|kindly|just)\s+)?(?:fixed|found|wrote|merged|noticed|asked|told|said|thinks|thought|believes|explained|answered|replied|called|emailed|signed|approved|rejected|joined|"
    r"lives|lived|maintains|suggested|proposed|reported|reviewed|wants|wanted|complained|confirmed|requested|debugged|refactored|gefunden|geschrieben|gemeldet|bemerkt|gefragt|sagt|sagte|fragt|fragte|schrieb|meint|wohnt|"
    r"écrit|trouvé|signalé|demandé|proposé|habite|pense|escribió|encontró|preguntó|dijo|propuso|vive|cree)\b"
)
DEED_BEFORE = re.compile(r"(?i)\b(?:met|meet|told|asked|emailed|thanked|interviewed|hired|invited|informed|mentored|traf|fragte|informierte|rencontré|demandé à|conocí a|pregunté a|according to|laut|selon|según|on behalf of|im auftrag von)\s+\Z")
#: What stands between the names of a list.
LISTED = re.compile(r"\s*(?:[,;&/]|,?\s*(?:and|und|y|e|et))\s*")
_UPPER_NAME = re.compile(rf"[A-ZÀ-Þ](?<![\w@/.\-'’][A-ZÀ-Þ])[A-ZÀ-Þ]+(?:[\-'’][A-ZÀ-Þ]{{2,}})?\s+[A-ZÀ-Þ]{{2,}}(?:[\-'’][A-ZÀ-Þ]{{2,}})?(?![\w@/]|\(|\.\w)")


def mentions(text: str) -> list[Span]:
    """The mentions of a text in order, not overlapping; of overlapping proposals the one with the best score stays."""
    if not text:
        return []
    mails = [s for s in emails(text) if s.score >= THRESHOLD]
    places = sorted((s for s in addresses(text) if s.score >= THRESHOLD), key=lambda s: s.start)
    found = mails + places + [s for f in (phones, id_numbers) for s in f(text) if s.score >= THRESHOLD]
    found += [s for s in names(text, places) if s.score >= THRESHOLD]
    kept: list[Span] = []
    starts: list[int] = []  # of the kept spans, which don't overlap, in order
    for s in sorted(found, key=lambda s: (-s.score, s.start, s.start - s.end)):
        i = bisect_right(starts, s.start)
        if (i == 0 or kept[i - 1].end <= s.start) and (i == len(kept) or kept[i].start >= s.end):
            starts.insert(i, s.start)
            kept.insert(i, s)
    return kept


def redact(text: str, spans: list[Span] | None = None) -> str:
    """The text with a typed placeholder for each mention; line breaks inside a mention stay."""
    spans = mentions(text) if spans is None else spans
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], PLACEHOLDERS[s.kind], "\n" * text.count("\n", s.start, s.end)]
        at = s.end
    return "".join(out) + text[at:]


def find_mentions(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``(key, line_no, pii_type, start, length, score)`` of all mentions, in one pass without a shuffle.

    Lines count from 1 in a text split at newlines; ``start`` is the offset of the
    mention in characters. Null and empty texts have none. Texts are searched whole.
    Repeated rows give repeated mentions.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, line_no bigint, pii_type string, start int, length int, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[column]):
                line, at = 1, 0
                for s in mentions(text) if text else ():
                    line, at = line + text.count("\n", at, s.start), s.start
                    rows.append((k, line, s.kind, s.start, s.end - s.start, s.score))
            yield pd.DataFrame(rows, columns=[key, "line_no", "pii_type", "start", "length", "score"])

    return docs.where(F.length(column) > 0).select(key, column).mapInPandas(run, schema)


def redacted(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``(key, text, n_mentions)``: every row with placeholders in its text; null stays null."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{column}` string, n_mentions int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = [mentions(t) if t else [] for t in pdf[column]]
            texts = [redact(t, s) if t else t for t, s in zip(pdf[column], spans)]
            yield pd.DataFrame({key: pdf[key], column: pd.Series(texts, dtype=object, index=pdf.index), "n_mentions": [len(s) for s in spans]})

    return docs.select(key, column).mapInPandas(run, schema)
