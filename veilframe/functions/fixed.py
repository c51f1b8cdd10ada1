"""Patterns, word lists and templates that results depend on, as plain text.

Patterns are (regular expression, flags); flags are i (ignore case) and s (dot matches line ends). The same text serves
Python's re and, with ``text.java``, Spark's regex functions.
"""

from __future__ import annotations

# Default action of every residue rule, in the order in which rules report.
POLICY = {
    "CORRUPTED_TOKEN": "block", "DOB": "block", "PERSON_HEADER": "block", "STREET": "block", "PLZ_CITY": "block", "PHONE": "block",
    "EMAIL": "block", "DIGIT_RUN": "block", "KVNR": "block", "CASE_NUMBER": "block", "NAME_CUE": "block", "DOB_MARKER": "block",
    "PARTIAL_NAME": "block", "TOKEN_ADJACENT_NAME": "block",
}
ACTIONS = ("block", "report", "ignore")

# Building blocks.
SCOPE = r"(?:\d+_)?"
NAME = r"[A-ZÄÖÜ][A-Za-zÄÖÜäöüß.-]"
STREET_END = r"straße|strasse|str\.?|weg|allee|platz|damm|ring|gasse|stieg|twiete|kamp|redder|chaussee|deich|brook|horst|wall|steig"
GREETING = r"Sehr|Mit|Liebe|Lieber|Guten|Freundliche[nrms]?"
WEEKDAY = r"(?:(?:Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag),?\s+)?"
BIRTH_GAP = r"(?:\s*am)?[ \t:.,\\/*-]{0,6}\s*"
CASE_LABEL = r"\b(?:Fall-Nr\.?|Fallnummer|Patienten-Nr\.?|Pat\.?\s*-?\s*Nr\.?|Aufn\.?\s*-?\s*Nr\.?)\s*:?\s*"
STREET = rf"(?:{NAME}*[ \t]+){{0,3}}[A-Za-zÄÖÜäöüß.-]*(?:{STREET_END})[ \t]+\d{{1,5}}[A-Za-z]?"
TOWN = rf"\d{{2}}[ \t]?\d{{3}}[ \t]+{NAME}*(?:[ \t]+(?!(?:{GREETING})\b){NAME}*){{0,3}}"
MAIL = r"[.\w][\w.%+-]*@[\w-]+[\w .-]*\.?\s?(?:de|com|org|net|eu)"
NUMERIC_DATE = r"[0-9]{1,2}\s*[.,/-]\s*[0-9]{1,2}\s*[.,/-]\s*[0-9]{2,4}"

# Field patterns in their order of application; group 1 is the value.
FIELDS = [
    ("PATIENT", r"\b(?:Patient|Name|Patientin|Patient name):\s*([^\n,;]+)", "i"),
    ("DOB", r"\b(?:DOB|Date of birth|Geboren(?:\s+am)?|Geburtsdatum|geb\s*\.?)" + BIRTH_GAP + rf"({NUMERIC_DATE}(?:\s+\d)?)", "i"),
    ("DOB", r"\b(?:Geburtsdatum|Geboren(?:\s+am)?|geb\s*\.?)" + BIRTH_GAP + rf"({WEEKDAY}[0-9]{{1,2}}\.\s*\S{{2,16}}\s+\d{{4}})", "i"),
    ("DOB", rf"(?<![\d.])\*[ \t]*({NUMERIC_DATE})(?!\d)", ""),
    ("CASE_NUMBER", r"\bage\s+\d{1,3}\s*,\s*(\d{6})\b", "i"),
    ("PATIENT", rf"\bPatienten\s+({NAME}+)\s*,", "i"),
    ("PATIENT", rf"\bSeite\s+\d+\s+von\s+\d+\s*,\s*({NAME}+)\s*,", "i"),
    ("PATIENT", r"\b((?:(?:Frau|Herr)[ \t]+)?Dr\.?[ \t]*(?:med\.?[ \t]*)?[A-ZÄÖÜ][.\w-]*[a-zäöüß](?:[ \t]+(?!(?:Geburtsdatum|Geboren|Patient(?:in)?|Fallnummer)\b)[A-ZÄÖÜ][\w-]*[a-zäöüß])*)\b", ""),
    ("ADDR", r"\b(?:Address|Adresse|wh\.?|wohnhaft(?:\s+in)?):?\s*([^\n]+)", "i"),
    ("CASE_NUMBER", CASE_LABEL + r"([A-Z0-9][A-Z0-9./-]{3,})", "i"),
    ("INSURANCE", r"\b(?:Insurance|Versicherung|Versichertennummer|Versichertennr|Versicherten-Nr|KVNR):?\s*([A-Z0-9 -]{6,})", "i"),
    ("INSURANCE", r"\b([A-Z][0-9]{9})\b", ""),
    ("ADDR", rf"\b({STREET})\b", "i"),
    ("ADDR", rf"\b({TOWN})\b", ""),
    ("EMAIL", rf"(?<!\w)({MAIL})(?!\w)", "i"),
    ("EMAIL", r"\b([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})\b", "i"),
    ("PHONE", r"\b(?:Tel(?:efon)?|Fax)\.?\s*:?\s*(\+?[0-9][0-9 ()/-]{5,}[0-9])", "i"),
    ("PHONE", r"(?<!\w)(?!\d{4}-\d{2}-\d{2}\b)(?!\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b)(\+?[0-9][0-9 ()/-]{7,}[0-9])(?!\w)", ""),
]
# The strict reading of the residence label: a word of its own, not any word that begins with wh.
STRICT_ADDRESS = r"\b(?:Address|Adresse|wh\.|wohnhaft(?:\s+in)?)(?!\w):?\s*([^\n]+)"

# Residue patterns, per line.
RESIDUE = {
    "CORRUPTED_TOKEN": (r"\[[A-Z_]+\[|\][A-Z_]", ""),
    "DOB": (r"\b(?:geb\s*\.?|geboren(?:\s+am)?|geburtsdatum)\s*:?(?:\s+am)?[ \t]*(?:\d{1,2}\s*[.,/-]\s*\d{1,2}\s*[.,/-]\s*\d{2,4}(?:\s+\d)?|" + WEEKDAY + r"\d{1,2}\.\s*(?:Januar|Februar|März|Maerz|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\s+\d{4})\b", "i"),
    "PERSON_HEADER": (rf"\b(?:Patienten\s+{NAME}+\s*,|Seite\s+\d+\s+von\s+\d+\s*,\s*{NAME}+\s*,)", "i"),
    "STREET": (rf"\b{STREET}\b", "i"),
    "PLZ_CITY": (rf"\b{TOWN}\b", ""),
    "PHONE": (r"\b(?:Tel(?:efon)?|Fax)\.?\s*:?\s*\+?[0-9][0-9 ()/-]{5,}[0-9]", "i"),
    "EMAIL": (r"(?<=\w)@(?=\w)", ""),
    "DIGIT_RUN": (r"(?<!\d)\d{6,}(?!\d)", ""),
    "KVNR": (r"\b[A-Z][0-9]{9}\b", ""),
    "CASE_NUMBER": (CASE_LABEL + r"[A-Z0-9][A-Z0-9./-]{3,}", "i"),
    "NAME_CUE": (
        r"(?:\b(?:Dr|Prof|DR|PROF)\.?|\b(?:Chefarzt|Chefärztin|Oberarzt|Oberärztin|Assistenzarzt|Assistenzärztin|Frau|FRAU|Herrn?|HERRN?)|\b(?i:geehrte[rs]?)|(?:\bFr|\bHr|\bgez)\.)"
        r"(?:[ \t]+(?i:med)\.?)?[ \t]+(?!(?i:Dr|Prof|Professor(?:in)?|med|Frau|Herrn?|Kollegin(?:nen)?|Kollegen?|Doktor|Damen|Herren)\b)"
        r"(?!(?i:\w*(?:logie|iatrie|medizin|heilkunde|chirurgie|therapie))\b)(?:[A-ZÄÖÜ][a-zäöüß]{2,}|[A-ZÄÖÜ]{3,})",
        "",
    ),
}
EXEMPT_BY_PLACE = ("STREET", "PLZ_CITY", "PHONE")

# Markers that residue rules and retention look for.
INSTITUTION = (r"\b(?:Krankenhaus|Klinik|Klinikum|Zentrum|SPZ|Praxis|gGmbH|e\.?\s*V\.?|Stiftung|Postfach|Akademisches|Institut|Ambulanz)\b|www\.|\b(?:IBAN|IK-?Nr|Ust-?ID)\b", "i")
PRIVATE = (r"\b(?:geb\s*\.?|geboren(?:\s+am)?|wh\.?|wohnhaft|nachrichtlich|empfänger|patient(?:in)?\s*:|name\s*:)", "i")
RECIPIENT = (r"^\s*(?:Frau|Herr|An|Empfänger|Empfaenger)\s*:?\s*$", "i")
LETTERHEAD = (r"^\s*[A-ZÄÖÜ][^,/\n]{1,60}/\s*[A-ZÄÖÜ][^,\n]{1,60},\s*\d{1,2}\.\d{1,2}\.\d{4}\s*$", "")
CONTACT_OR_NUMBER = (r"\b(?:Tel(?:efon)?|Fax)\.?\s*:?|\b(?:Ust-?ID|IK-?Nr|IBAN)\b", "i")
BIRTH_MARKER = (r"\bGeburtsdatum\b|\bgeb\.", "i")
SAFE_AFTER_BIRTH = (rf"\bage\s+\d+\b|\[{SCOPE}DOB_", "i")
PARTIAL_NAME = (rf"\[{SCOPE}PATIENT_\d+\]\s+(?!(?:geb|geboren|Geburtsdatum|age)\b)\w{{3,}}", "i")
SWEPT_BIRTH = (r"\*age\s+\d", "")
ANY_TOKEN = (rf"\[{SCOPE}[A-Z_]+_\d+\]", "")
CAPITALISED = (r"\b[A-ZÄÖÜ][A-Za-zäöüß-]{2,}\b", "")
PATIENT_TOKEN = (rf"\[{SCOPE}PATIENT_\d+\]", "")
TOKEN_THEN_NAME = (rf"\[{SCOPE}PATIENT_\d+\][;,]?[ \t]+[A-ZÄÖÜ][A-Za-zäöüß-]{{2,}}", "")
ROLE_LINE = (r"^\s*(?:Fach(?:arzt|ärztin)|Arzt|Ärztin|Oberarzt|Oberärztin|Chefarzt|Chefärztin|Dr\.?|Prof\.?)\b", "i")
OCR_GARBAGE = (r"[{}@#%&\\]", "")
BARE_TOKEN = (rf"^\s*\[{SCOPE}(?:PATIENT|ADDR)_\d+\]\s*$", "")
LONE_WORD = (r"^\s*[A-ZÄÖÜ][A-Za-zäöüß-]{2,}\s*$", "")
HEADINGS = ["diagnosen", "diagnose", "anamnese", "befund", "befunde", "medikation", "epikrise", "beurteilung", "therapie", "labor", "verlauf", "zusammenfassung", "empfehlung", "empfehlungen", "procedere", "nachrichtlich", "anlage", "anlagen"]
GENERIC_MAILBOXES = {"info", "kontakt", "praxis", "zentrum", "office", "sekretariat", "verwaltung", "spz", "empfang"}

# Tokens, entity validation and dates of the rewriter.
PROTECTED = (rf"\[{SCOPE}[A-Z][A-Z_]*_\d+\]|\bage\s+\d{{1,3}}\b", "i")
ADDRESS_MATERIAL = (
    rf"\b[A-Za-zÄÖÜäöüß.-]*(?i:(?:{STREET_END}))\b|\b{NAME}*[ \t]+\d{{1,5}}[A-Za-z]?\b|\b\d{{1,5}}[A-Za-z]?[ \t]+{NAME}*(?:[ \t]+{NAME}*){{0,3}}\b|\b\d{{2}}[ \t]?\d{{3}}(?:[ \t]+{NAME}*)?\b", "")
AGE_WORD = (r"\b\d{1,3}\s*-?\s*j(?:ä|ae)hrig\w*\b", "i")
UNIT_VALUE = (r"\b\d+(?:[.,]\d+)?(?:\s*-\s*\d+(?:[.,]\d+)?)?\s*(?:kg|cm|mm|hz|mg|g|ml|l|/s)\b", "i")
KINSHIP = (r"\b(?:Geschwisterkind|Geschwister|Kind|Mutter|Vater|Eltern|Bruder|Schwester|Sohn|Tochter)\w*\b", "i")
INSTITUTION_NAME = (r"\b(?:Krankenhaus|Kinderkrankenhaus|Klinik|Klinikum|Zentrum|Stift|Praxis|Universität|Universitaet|gGmbH|GmbH|e\.?\s*V\.?|Amtsgericht|Institut|Ambulanz|Stiftung)\b", "i")
PERSON_CUE = (r"(?:Dr\.?|Prof\.?|Chefarzt|Chefärztin|Oberarzt|Oberärztin|Assistenzarzt|Assistenzärztin|Frau|Herr)\s*(?:med\.?\s*)?(?:\n\s*)?$", "i")
QUANTIFIER = (r"\b(?:zwei|zweier|beide|mehrere)\s+$", "i")
TECHNICAL = (r"^\s*:\s*[-+]?\d+(?:[.,]\d+)?\s*(?:hz|khz|pV|µV|uV|kg|cm|mg|/s)\b", "i")
MEDICAL_TERMS = {"rolandofoki", "rolando-foki", "rolandische foki"}
GENERIC_WORDS = {"keine", "kein", "keinen", "keinem", "keiner", "keines", "ohne", "nicht", "sehr", "und", "oder", "der", "die", "das", "den", "dem", "ein", "eine", "einer", "eines", "mit", "von", "zu", "im", "in", "am", "an"}
TRAILING_GREETING = (rf"(?:[ \t]+(?:{GREETING}))+$", "i")
BIRTH_BEFORE = (r"(?:\bDOB\b|Date of birth|Geburtsdatum|geboren(?:\s+am)?|geb\s*\.?)[^\n]{0,64}$", "i")
PLACE_OF_PATIENT = (rf"(?:\[{SCOPE}PATIENT_\d+\]|\bPatient(?:in)?\b).{{0,80}}(?:wohnt|wohnhaft|lebt|Wohnort|Wohnsitz).{{0,80}}$|\b(?:Wohnort|Wohnsitz|wohnhaft)\s*:?[^\n]*$", "i")
MONTHS = {"januar": 1, "februar": 2, "märz": 3, "maerz": 3, "april": 4, "mai": 5, "juni": 6, "juli": 7, "juëi": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "dezember": 12}
KIND_OF = {"PERSON": "PATIENT", "NAME": "PATIENT", "PATIENT": "PATIENT", "ADDRESS": "ADDR", "ADDR": "ADDR", "DOB": "DOB", "INSURANCE": "INSURANCE", "EMAIL": "EMAIL", "PHONE": "PHONE"}
SWEPT_KINDS = ("PATIENT", "ADDR", "INSURANCE", "CASE_NUMBER", "EMAIL", "PHONE")
LEDGER_ORDER = ("PATIENT", "ADDR", "DOB", "PHONE", "EMAIL", "INSURANCE", "CASE_NUMBER")

# Boilerplate lines.
PAGE_LINE = (r"^\s*Seite\s+\d+\s*(?:von|/)\s*\d+\b", "i")
REGISTRY = (r"\b(?:IBAN|BIC|SWIFT|Ust-?\s?Id\s?Nr|Ust-?ID|USt-?tdNr|St[.-]?Nr|Steuer-?Nr|Steuernummer|IK-?NR|HRB|Amtsgericht|Registergericht|Sitz der Gesellschaft|Gesch[aä]ftsf[uü]hr|Postfach|Vorsitzende|Aufsichtsrat|Bankverbindung|Spendenkonto|Sparkasse|Volksbank|Commercial Bank|Handelsregister)\b", "i")
CONTACT = (r"www\.|https?://|\bTel(?:efon)?\.?\s*:?\s*\+?\d|\bFax\.?\s*:?\s*\+?[\d\[]|@", "i")
INSTITUTION_PLACE = (r"\b\d{5}\s+[A-ZÄÖÜ]|\bPostfach\b|stra[sß]e\s+\d+", "i")
LINKS = (r"www\.\S+|https?://\S+|\S+@\S+", "")
PROSE_WORD = (r"[A-Za-zÄÖÜäöüß]{4,}", "")

# Structuring.
DATE_LINE = (r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}\.\d{1,2}\.\d{4}\b", "")
LAB_LINE = (r"\b(HbA1c|LDL|HDL|CRP|TSH|glucose)\b", "i")
MED_LINE = (r"\b(metformin|atorvastatin|insulin|levothyroxine|amlodipine)\b|\b\d+\s*mg\b", "i")
BODY_DATE = (r"\b(?:den|vom)\s+(\d{1,2}\.\d{1,2}\.\d{4})\b", "i")
METADATA_TOKEN = (r"\[(?:\d+_)?[A-Z][A-Z_]*_\d+\]", "")
PERSON_TITLE = (r"\b(?:Dr\.?|Prof\.?|Frau|Herr)\b", "i")
SECTIONS = [("kontext", "Kontext"), ("untersuchung", "Untersuchung"), ("befund", "Befund"), ("beurteilung", "Beurteilung"), ("empfehlung", "Empfehlung / Procedere")]
NO_ENTRIES = "- No structured entries yet."
INBOX_SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".txt", ".md")

# Egress guard.
PII_TOKEN = (r"\[(?:PATIENT|DOB|ADDR|INSURANCE|EMAIL|PHONE)_\d+\]", "")
STRICT_PII_TOKEN = (rf"\[{SCOPE}(?:PATIENT|DOB|ADDR|INSURANCE|EMAIL|PHONE|CASE_NUMBER)_\d+\]", "")
RAW_PII = [
    (r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "i"),
    (r"\b(?:DOB|Date of birth|Geboren|Geburtsdatum):", "i"),
    (r"\b(?:Address|Adresse|Insurance|Versicherung|KVNR):", "i"),
    (r"\b(?!\d{4}-\d{2}-\d{2}\b)(?!\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b)(?!\d{4}[/-]\d{4}\b)\+?[0-9][0-9 ()/-]{7,}[0-9]\b", ""),
]

# Model replies.
THINK_TAGS = ["think", "thinking", "reasoning", "thought", "REASONING_SCRATCHPAD"]
FENCE = (r"```(?:json)?\s*(.*?)\s*```", "is")
NOT_PERSONS = {"eltern", "mutter", "vater", "kind", "sohn", "tochter", "familie", "patient", "patientin", "ehefrau", "ehemann", "geschwister", "junge", "mädchen", "parents", "mother", "father", "child"}
CAPITALISED_WORD = (r"\b[A-ZÄÖÜ][a-zäöüß]{2,}\b", "")

# Letters.
LETTER_NOTE = "---\nDieses Schreiben ist ein vorbereitender Entwurf und ersetzt keine ärztliche Beratung.\n"
LETTERS = {
    "paper": "{sender}\n\n{recipient}\n\n{place}, {date}\n\n**{subject}**\n\nSehr geehrte Damen und Herren,\n\n{body}\n\nMit freundlichen Grüßen\n\n\n{sender}\n\n" + LETTER_NOTE,
    "email": "Betreff: {subject}\n\nSehr geehrte Damen und Herren,\n\n{body}\n\nMit freundlichen Grüßen\n{sender}\n\n" + LETTER_NOTE,
}
LETTER_SUBJECT = "Ärztliche Einschätzung zu {patient}"
LETTER_BODY = "wir betreuen {patient} und bitten um Ihre ärztliche Einschätzung.\n\nZusammenfassung der bekannten Befunde:\n\n{problems}\n\nÜber eine Rückmeldung zu weiterführender Diagnostik würden wir uns freuen."
