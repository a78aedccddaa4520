"""Shapes of personal information, and the cues that label a sample for training.

Shapes mark what could be an item, whether it is one or not: they are features
of the model and fix an item's ends. Cues are what texts of any kind show beside
items and beside what only looks like them: titles, greetings, signatures, form
labels, verbs of contact, citations, names of tests and places. They label part
of the bounded training sample and nothing else; what no cue is beside stays
open in training.
"""

from __future__ import annotations

import re

KINDS = ("email", "phone", "id_number", "address", "name")

_DOT = r"(?:\s?\(dot\)\s?|\s?\[dot\]\s?| dot |\.)"
EMAIL = re.compile(
    rf"(?<![\w.+@/-])[\w+%-]+(?:(?:\.|[ ]dot[ ])[\w+%-]+)*(?:\s?@\s?|\s?\(at\)\s?|\s?\[at\]\s?|\s?\{{at\}}\s?| at (?=[\w-]+(?: dot [\w-]+)+))[a-z][\w-]*(?:{_DOT}[\w-]+)*{_DOT}[a-z]{{2,}}(?![\w@])", re.I
)
#: Number groups of the countries at hand, with extension.
_EXT = r"(?:\s?(?:ext\.?|extension|x|#|durchwahl|poste)\s?\d{1,5})?"
PHONE = re.compile(
    r"(?<![\w+./-])(?:"
    r"\+\d{1,3}[\s.-]?(?:\(0\)\s?)?\(?\d{1,5}\)?(?:[\s./-]?\d{2,8}){1,5}"
    r"|00\d{2}[\s.-]?\d{2,4}(?:[\s.-]?\d{2,8}){0,4}"
    r"|(?:1[-.\s])?(?:\(\d{3}\)\s?|\d{3}[-.\s]?)\d{3}[-.\s]?\d{4}"
    r"|\(?0\d{2,4}\)?[\s/-]?\d{3,8}(?:[\s-]\d{2,4}){0,3}"
    r"|0\d(?:[.\s-]\d{2}){4}"
    r"|\d{3}[-.]\d{4}"
    rf"){_EXT}(?![\w]|[-./]\d)",
    re.I,
)
#: Forms of document, insurance and patient numbers.
ID = re.compile(
    r"(?<![\w./-])(?:"
    r"MRN-?\d{5,9}|[A-Z]{2}(?:[\s-]?\d{2}){3}[\s-]?[A-Z]|H\d{6}/\d{2}|X[A-Z]?\d{7,8}|X[A-Z] \d{3} \d{3}"
    r"|\d{2}\.?\d{3}\.?\d{3}-[A-Z]|\d{3}[-.\s]?\d{2}[-.\s]?\d{4}|\d{3}[-\s]\d{3}[-\s]\d{4}"
    r")(?![\w]|[-./]\d)",
    re.I,
)
#: Words that announce the number of a document, insurance or patient record, in the languages at hand.
ID_WORDS = (
    r"ssn|social security|national insurance|insurance|nhs|passport|identity card|id card|driving licen[cs]e|driver'?s licen[cs]e|licen[cs]e|tax id|patient|hospital|medical record|record|mrn|"
    r"reisepass|pass|personalausweis|ausweis(?:nummer)?|versicherung(?:snummer)?|versichertennummer|pasaporte|documento?|dni|nie|seguridad social|afiliaci[oó]n|passeport|carte d'identit[eé]|s[eé]curit[eé] sociale|dossier"
)
_ID_SAID = rf"\b(?:{ID_WORDS})(?:[ -]type)?(?:\s(?:no|nr|num)\b\.?|\s?n[°º]|\s(?:number|nummer|n[uú]mero|num[eé]ro|card|record|id))*\s?[:#]?\s?"
#: A part of each of these words.
_ID_HINTS = (
    "ssn", "social", "insurance", "nhs", "passp", "card", "licen", "tax id", "patient", "hospital", "record", "mrn", "pass ", "ausweis", "versich", "pasap", "document", "dni", "nie ", "seguridad", "afiliaci",
    "carte d", "curit", "dossier", "身份证", "护照", "证件", "病历", "医保",
)
#: A number as such a word announces it, in whatever form.
CAPTIONED_ID = re.compile(rf"(?:{_ID_SAID}|(?:身份证|护照|证件|病历|医保)(?:号码?)?(?:为|是|[:：])?\s?)(?:(?:is|was|lautet|es|est)\s)?(?P<id>(?=(?:[ ./-]?[A-Z0-9])*?\d)(?:[A-Z]{{1,4}}[ -]?)?\d[A-Z0-9]*(?:[ ./-]\d[A-Z0-9]*)*(?:-?[A-Z])?)(?![\w]|[-./]\d)", re.I)
_W = r"[^\W\d_][\w’'-]*"
_UNIT = r"(?:(?:flat|apt|apartment|unit|suite)\.?\s\d+[a-z]?|#\d+)"
_CODE = r"(?:[A-Z]{2}\d{1,2}\s\d[A-Z]{2}|[A-Z]{2}\s\d{5}|\d{5})"
#: Words and order of street addresses in the languages at hand.
_TOWN = rf"{_W}(?![\w.+-]*\s?(?:@|\(at|\[at|at\s))(?<!\band)(?<!\bwhich)(?<!\bwhere)(?<!\bbut)"
_LAST = rf"{_W}(?=[.;,\n]|\s\s|$|,?[ ]{_CODE}(?!\d))"
_EN = (
    r"(?:(?:street|road|avenue|boulevard|parkway|highway|lane|hill|terrace|close|drive|court|crescent|place|square|way|gardens|grove|mews)\b"
    rf"|(?:st|rd|ave|ln|dr|blvd|pkwy|hwy)\b(?:\.(?=[.,;]|[ ](?:{_CODE}(?!\d)|{_UNIT}|and\b)|\n(?:[\d+(]|{_LAST})))?)"
)
_PLAIN = r"(?!(?:the|a|an|of|to|in|on|and|or|for|with|by|at|their|our|his|her|that|which)\b)"
_NAMED = rf"(?:{_W}\s{_EN}|{_PLAIN}{_W}\s(?:{_PLAIN}{_W}\s){{1,2}}(?:street|road|avenue|boulevard|parkway|highway|terrace|(?:ave|blvd)\b\.?)\b)"
_STREET = rf"\d+[a-z]?\s{_NAMED}(?:\s(?:nw|ne|sw|se|north|south|east|west)\b\.?)?(?:,?\s{_UNIT})?(?:(?:,\s{_TOWN}|,?\n{_LAST})(?:,?[ ]{_CODE}(?!\d))?|,?[ ]{_CODE}(?!\d))?"
_BEFORE = r"(?<![\w/-])"


def _any(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.I)


#: (kind, what a text in small letters must hold for the form to occur, a digit if None, form); of overlapping matches the longer counts.
FORMS = [
    ("email", ("@", "(at)", "[at]", "{at}", " dot "), EMAIL),
    ("phone", None, PHONE),
    ("id_number", None, ID),
    ("address", None, _any(rf"{_BEFORE}(?:{_UNIT},\s)?{_STREET}")),
    ("address", ("house, ", "cottage, ", "lodge, ", "court, "), _any(rf"{_BEFORE}{_W}\s(?:house|cottage|lodge|court),\s{_STREET}")),
    (
        "address",
        ("straße ", "strasse ", "str. ", "weg ", "platz ", "allee ", "gasse "),
        _any(rf"{_BEFORE}{_W}(?:(?<=straße)|(?<=strasse)|(?<=weg)|(?<=platz)|(?<=allee)|(?<=gasse)|(?<=str)\.)\s\d+(?:\s?[a-z]\b)?(?:,\s\d{{5}}\s{_W})?"),
    ),
    (
        "address",
        ("calle", "c/", "avda", "avenida", "plaza", "paseo"),
        _any(rf"{_BEFORE}(?:calle|c/|avda\.|avenida|plaza|paseo)\s?{_W},\s\d+(?:,\s(?:\d+º\s?[a-z]\b|bajo|ático))?(?:,\s\d{{5}}\s{_W})?"),
    ),
    (
        "address",
        (", rue ", ", avenue ", ", av. ", ", bd ", ", boulevard ", ", chemin ", ", place ", ", allée ", ", quai ", ", impasse "),
        _any(rf"{_BEFORE}\d+(?:\s(?:bis|ter))?,\s(?:rue|avenue|av\.|bd|boulevard|chemin|place|allée|quai|impasse)\s{_W}(?:,\s\d{{5}}\s{_W})?"),
    ),
]
_DIGIT = re.compile(r"\d")


def shape_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Where the forms of each kind occur, in order and without overlaps within a kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    digits, low = _DIGIT.search(text) is not None, text.lower()
    for kind, needs, pattern in FORMS:
        if digits if needs is None else any(x in low for x in needs):
            out[kind] += [m.span() for m in pattern.finditer(text)]
    if digits and any(x in low for x in _ID_HINTS) and (captioned := [m.span("id") for m in CAPTIONED_ID.finditer(text) if sum(c.isdigit() for c in m["id"]) >= 5]):
        ids = sorted(set(out["id_number"] + captioned), key=lambda x: (x[0], -x[1]))
        out["id_number"] = [x for i, x in enumerate(ids) if not i or x[0] >= max(b for _, b in ids[:i])]
    kept: list[tuple[int, int]] = []
    for a, b in sorted(out["address"], key=lambda x: (x[0], -x[1])):
        if not kept or a >= kept[-1][1]:
            kept.append((a, b))
    out["address"] = kept
    return out


#: What stands before a person's name, in the languages at hand.
_TITLE = r"dr|prof|professor|mr|mrs|ms|miss|mx|sir|frau|herrn?|fräulein|monsieur|madame|mme|mlle|se[ñn]ora?|sra?|do[ñn]a?|doctora?|docteure?|doktor"
_GREETING = r"dear|hi|hello|hey|liebe[rs]?|hallo|geehrte[rs]?|chère?|bonjour|estimad[oa]|querid[oa]|hola"
_LABEL = (
    r"names?|contacts?|contact person|interviewer|interviewee|interviewed by|participant|patient|client|staff|author|from|to|cc|attn|signed|signature|prepared by|supervisor|witness|"
    r"correspondence|reviewer|therapist|clinician|coordinator|speaker(?: \w)?|ansprechpartner(?:in)?|kontakt|unterschrift|teilnehmer(?:in)?|nombre|contacto|firmado|responsable|nom|signataire|interlocuteur"
)
_SAID = r"my name is|name's|i am|i['’]?m|this is|call me|me llamo|mi nombre es|je m['’]appelle|ich hei(?:ß|ss)e|mein name ist"
_DID = r"(?:signed|written|completed|conducted|reported|led|prepared|approved|collected|entered|checked|reviewed|rated|coded) (?:by|as|for)|on behalf of|c/o"
_ASKED = r"ask(?:ed)? for|contact|write to|speak (?:to|with)|spoke (?:to|with)|talk to|sent to|send to|call|thank|thanks to|bitte an|wenden sie sich an|escriba a|contacte (?:a|con)|pregunte por|pertenece a|contacter|demander|écrire à"
_REGARDS = r"(?:kind |best |warm )?regards|best wishes|(?:yours )?sincerely|yours(?: faithfully| truly)?|cheers|thanks|thank you|mit freundlichen gr(?:ü|ue)(?:ß|ss)en|viele gr(?:ü|ue)(?:ß|ss)e|cordialement|bien à vous|atentamente|saludos"
TITLES = {fold for t in _TITLE.replace("[ñn]", "n").split("|") for fold in (t.rstrip("?"), re.sub(r".\?$", "", t))}
_CUE = (
    rf"(?:\b(?:{_TITLE})\.?\s|\b(?:{_GREETING})[ ]|(?:^|[\n.;|(,]|\b)\s*(?:{_LABEL})\s?:\s|\b(?:{_SAID})\s|\b(?:{_DID})\s|\b(?:{_ASKED})\s|\b(?:{_REGARDS}),?[ ]?\n"
    r"|(?:姓名|联系人|患者|签名|受访者|负责人|访谈员)[:：]|我叫|我是)\s*"
)
NAME_BEFORE = re.compile(f"{_CUE}$", re.I)
NAME_CUED = re.compile(f"{_CUE}(?=[^\\W\\d_])", re.I)
#: What stands behind a person's name.
NAME_AFTER = re.compile(
    r"\s?[<(]\s?[\w.+%-]+(?:\s?@|\s?[(\[{]at[)\]}]| at )|,?\s\(?(?:tel|phone|mobile|m[oó]vil|tél|mail|e-mail)\b|\s\((?:nhs|patient|participant|ssn|passport)\b|,\s(?:ssn|passport|nhs)\b"
    r"|\s(?:wrote|said|told|called|rang|phoned|emailed|asked|lives|moved|wohnt|schrieb|sagte|vive|escribió|dijo|llamó|habite|écrit|appelle)\b|\s?(?:先生|女士|小姐|医生|教授|老师|同学|的(?:证件|身份证|护照|电话|手机|邮箱|地址|住址))",
    re.I,
)
#: What shows that a name is cited, or stands in that of a test, place or institution.
CITED_AFTER = re.compile(r"\s(?:et al|u\. ?a\.)|['’]?s?\s\(?(?:19|20)\d\d[a-z]?\b|['’]?s?\s?[(（](?:19|20)\d\d|\s(?:and|und|y|e|et|&)\s[^\W\d_][\w’'-]+\s\(?(?:19|20)\d\d", re.I)
CITED_BEFORE = re.compile(r"[^\W\d_][\w’'-]+\s(?:and|und|y|e|et|&)\s$", re.I)
_THING = (
    r"inventory|diary|form|test|scale|index|battery|checklist|questionnaire|survey|task|theory|method|effect|model|paradigm|university|hospital|clinic|institute|school|college|centre|center|foundation|trust|"
    r"road|street|avenue|lane|hill|house|park|bridge|station|library|press|fragebogen|skala|inventar|universität|klinik|schule|escala|cuestionario|universidad|hospital|échelle|questionnaire|université"
)
THING_AFTER = re.compile(rf"[’']?s?[ ](?:(?!(?:on|in|of|at|to|for|the|a|an|and)\b)(?-i:[A-Z])[\w-]*[ ]){{0,2}}(?:{_THING})\b", re.I)
THING_BEFORE = re.compile(r"\b(?:university of|universit(?:ät|y|é)(?: de)?|universidad de|escala(?: de)?|échelle(?: de)?|inventario(?: de)?|test(?: de)?|questionnaire(?: de)?)\s$", re.I)
PLACE_BEFORE = re.compile(r"\b(?:in|at|near|from|bei|aus|nach|desde|across|around|outside)\s$", re.I)
_ID_BEFORE = re.compile(rf"(?:{_ID_SAID}|(?:身份证|护照|证件|病历)(?:号码?)?(?:为|是|[:：])?\s?)$", re.I)
_NO_ID = re.compile(r"\b(?:serial|look like|barcode|protocol|grant|batch|order|codes?|firmware|version|bus|device|model|sheet|isbn|issn|trial|registration|study|to|doi:\S*)(?:\s(?:no|nr)\.?|\snumber|\sran from)?\s*[:#]?\s*$", re.I)
_SURE_ID = re.compile(r"MRN-?\d{5,9}|[A-Z]{2}(?:[\s-]?\d{2}){3}[\s-]?[A-Z]|H\d{6}/\d{2}|X[A-Z]?\d{7,8}|X[A-Z] \d{3} \d{3}|\d{2}\.?\d{3}\.?\d{3}-[A-Z]|\d{3}([-.\s])\d{2}\1\d{4}", re.I)
_PHONE_BEFORE = re.compile(
    r"(?:\b(?:tel|telephone|phone|mobile|cell|fax|call|ring|rang|text|sms|number|hotline|me on|us on|ext|telefon(?:isch)?|handy|unter|erreichbar|teléfono|móvil|llame al?|tél|téléphone|appelez|portable|numéro)\b\.?"
    r"(?:\s(?:on|at|from|is|under|unter|al|au|me|us|no\.?))*|电话|致电|手机)\s*[:：(]?\s*$",
    re.I,
)


def in_shapes(text: str, shapes: dict[str, list[tuple[int, int]]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(items, open spans) among the shapes of a text: addresses of mail and
    streets are taken for items; numbers are where a word announces them, are
    none where a word says what else they are, and else stay open."""
    found = [(a, b, k) for k in ("email", "address") for a, b in shapes[k]]
    beside = {x for a, b, _ in found for x in (a, b)}
    unsure: list[tuple[int, int, str]] = []
    for a, b in shapes["id_number"]:
        before = text[max(0, a - 40) : a]
        if _ID_BEFORE.search(before) or _SURE_ID.fullmatch(text[a:b]) and not _NO_ID.search(before):
            found.append((a, b, "id_number"))
        elif not _NO_ID.search(before):
            unsure.append((a, b, "id_number"))
    for a, b in shapes["phone"]:
        before = text[max(0, a - 40) : a]
        if len(set(_DIGIT.findall(text[a:b]))) == 1 or _ID_BEFORE.search(before) or _NO_ID.search(before):
            continue
        gap = re.search(r"[\s/,;:|(–-]{0,4}(?:(?:\b(?:old|new|other|former|or|and|und|oder|y|o|et|ou)\b)(?:\sone)?[\s/,;:|(–-]{1,3}){0,2}$", before)
        next_to = (gap.end() > gap.start() and a - len(gap.group()) in beside) or any(b + k in beside for k in range(1, 4))
        if _PHONE_BEFORE.search(before) or text[a] == "+" or next_to:
            found.append((a, b, "phone"))
            beside |= {a, b}
        else:
            unsure.append((a, b, "phone"))
    return found, unsure


LISTED = re.compile(r"(?:[;,]|[;,]?\s(?:and|und|y|et|or|&)|、)\s?$", re.I)


def name_cue(text: str, a: int, b: int, tokens: int, after_name: bool = False) -> bool | None:
    """Whether the name-like run text[a:b] of so many words is a person's name;
    None if no cue tells. after_name: a name ends before what LISTED means."""
    before, after = text[max(0, a - 40) : a], text[b : b + 60]
    if CITED_AFTER.match(after) or CITED_BEFORE.search(before) and CITED_AFTER.match(after) or THING_AFTER.match(after) or THING_BEFORE.search(before):
        return False
    if tokens == 1 and PLACE_BEFORE.search(before):
        return False
    if NAME_BEFORE.search(before) or NAME_AFTER.match(after) or after_name and tokens > 1:
        return True
    return None


_CITED = re.compile(r"([^\W\d_]{4,})(?:[ ]et[ ]al\.?|[ ](?:and|und|y|et|e)[ ]([^\W\d_]{4,}))?[ ]\(\d{4}[a-z]?\)", re.I)
_INSTRUMENT = re.compile(r"([^\W\d_]{4,})[ ](?:[A-Z][\w-]+[ ]){1,2}(?:inventory|diary|form|test|scale|index|battery|checklist|questionnaire)\b", re.I)


def cited(text: str) -> set[str]:
    """Authors of citations and persons that instruments are called after: names, though no items."""
    return {w for m in _CITED.finditer(text) for w in m.groups() if w} | {m.group(1) for m in _INSTRUMENT.finditer(text)}
