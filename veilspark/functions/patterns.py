"""The detection registry: one row a pattern.

Fixed values: the patterns, confidences and types that results must equal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

I = re.IGNORECASE  # noqa: E741


@dataclass(frozen=True)
class Spec:
    entity_type: str
    pattern: str
    base: float
    group: int = 0
    validator: str | None = None
    context: str | None = None
    language: str | None = None
    deny: bool = False
    needs: str | None = None  # a text without this substring has no match
    tiers: tuple[float | None, float | None] = (None, None)  # confidence if valid, if not
    flags: int = 0


MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
NUMERIC_DATE = r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}"
ANY_DATE = NUMERIC_DATE + r"|\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}"
NOT_NAMES = (
    "Employee|Agent|Support|Customer|Account|Project|Product|System|Technical|Hello|Dear|Case|Ticket|Record|Report|Table|Section|Chapter|Module"
    "|Service|Server|Client|Device|Network|Database|Access|Error|Warning|Request|Response|Status|Version|Update|Delete|Create|Default"
    "|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
    "|January|February|March|April|June|July|August|September|October|November|December"
)
H = "[0-9a-fA-F]{1,4}"
HEX2 = "[0-9A-Fa-f]{2}"
CASE = r"\d{1,2}:\d{2}-(?:cv|cr|mc|mj|po|pv)-\d{4,6}|\d{4}-[A-Z]{1,4}-\d{2,8}|\d{4}-\d{4,8}"

REGISTRY: tuple[Spec, ...] = (
    Spec("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.99, context="EMAIL_ADDRESS", needs="@"),
    Spec("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.97, validator="ssn_dash", context="US_SSN"),
    Spec("US_SSN", r"\b\d{3}\s\d{2}\s\d{4}\b", 0.93, validator="ssn_space", context="US_SSN"),
    Spec("US_SSN", r"\b\d{9}\b", 0.65, validator="ssn_nodash", context="US_SSN"),
    Spec("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.96, validator="ipv4", context="IP_ADDRESS", needs="."),
    Spec("IP_ADDRESS", rf"(?<![:\w])(?:(?:{H}:){{7}}{H}|(?:{H}:){{1,7}}:|(?:{H}:){{1,6}}:{H}|::(?:{H}:){{0,5}}{H}|::)(?![:\w])", 0.92, context="IP_ADDRESS", needs=":"),
    Spec("CREDIT_CARD", r"\b(?:\d[ -]?){12,18}\d\b", 0.80, validator="credit_card", context="CREDIT_CARD"),
    Spec("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 0.78, validator="iban", context="IBAN"),
    Spec("PHONE_NUMBER", r"(?<!\w)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?!\w)", 0.80, validator="phone", context="PHONE_NUMBER", language="en"),
    Spec("PHONE_NUMBER", r"(?<!\w)(?:\+34[-.\s]?)?(?:6|7|9)\d{2}[-.\s]?\d{3}[-.\s]?\d{3}(?!\w)", 0.80, validator="phone", context="PHONE_NUMBER", language="es"),
    Spec("PHONE_NUMBER", r"(?<!\w)(?:\+33[-.\s]?)?(?:0?[1-9])(?:[-.\s]?\d{2}){4}(?!\w)", 0.80, validator="phone", context="PHONE_NUMBER", language="fr"),
    Spec("PERSON_NAME", r"\b(?:Dr|Mr|Mrs|Ms|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b", 0.86, context="PERSON_NAME", language="en", deny=True),
    Spec("PERSON_NAME", r"\b(?:Sr|Sra|Srta|Dra)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b", 0.86, context="PERSON_NAME", language="es", deny=True),
    Spec("PERSON_NAME", r"\b(?:M|Mme|Dr)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b", 0.86, context="PERSON_NAME", language="fr", deny=True),
    Spec("PERSON_NAME", rf"(?<![A-Za-z])(?!(?:{NOT_NAMES})[ \t])[A-Z][a-z]{{2,}}[ \t]+[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+)?(?![A-Za-z])", 0.68, context="PERSON_NAME", deny=True),
    Spec("PERSON_NAME", r"\b[A-Z][a-z]+\s+[A-Z]\.\b", 0.85, context="PERSON_NAME", deny=True),
    Spec("PERSON_NAME", r"\b(?:for|belongs\s+to|associated\s+with)\s+(?:Mr|Mrs|Ms|Dr|Prof)?\.?\s*([A-Z][a-z]+)\b", 0.81, 1),
    Spec("PERSON_NAME", r"\b(?:alias|called|named|refer(?:red)?\s+to(?:\s+as)?)\s+([A-Z][a-z]{2,})\b", 0.82, 1, flags=I),
    Spec("PERSON_NAME", r"\b(?:name\s+is|patient|employee|client|resident|member|user|account\s+holder|beneficiary|author|sender|recipient|contact|applicant|insured|claimant|defendant|plaintiff|witness|tenant|signed\s+by|submitted\s+by|prepared\s+by|reviewed\s+by|assigned\s+to)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b", 0.83, 1),
    Spec("PERSON_NAME", r"\b([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+)?)'s\s+(?:account|email|phone|address|record|file|case|report|application|profile|password|card|payment|order|appointment|prescription|information|data|details)\b", 0.84, 1, deny=True),
    Spec("PERSON_NAME", r"\b([A-Z][a-z]+\s+[A-Z]\.)\s", 0.84, 1, context="PERSON_NAME", deny=True),
    Spec("PERSON_NAME", r"\[([A-Z][a-z]{2,})\]", 0.82, 1, context="PERSON_NAME", deny=True),
    Spec("PERSON_NAME", r"\b(?:call\s+me|I(?:'m|\s+am)\s+called|they\s+call\s+me)\s+([A-Z][a-z]{2,})\b", 0.83, 1, context="PERSON_NAME"),
    Spec("PERSON_NAME", r"\b([A-Z][a-z]+\s+(?:de|van|von|di|da|del|della|der|den|la|le|du|dos|das|ten|ter)\s+[A-Z][a-z]+)\b", 0.80, 1, context="PERSON_NAME", deny=True),
    Spec("DATE_OF_BIRTH", rf"\b(?:born|DOB|date\s+of\s+birth|birth\s*date|d\.o\.b\.?)\s*[:\-]?\s*({ANY_DATE})\b", 0.85, 1, flags=I),
    Spec("DATE_ISO", r"\b(\d{4}-\d{2}-\d{2})\b", 0.85, 1, validator="date_iso"),
    Spec("DATE_TIME", rf"\b((?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}|{NUMERIC_DATE})\b", 0.78, 1, flags=I),
    Spec("MAC_ADDRESS", rf"\b((?:{HEX2}[:\-]){{5}}{HEX2})\b", 0.92, 1, needs=":"),
    Spec("DRIVERS_LICENSE", r"\b(?:driver'?s?\s*licen[cs]e|license\s*(?:number|no|#)|permis\s*(?:de\s+)?conduire|licencia\s*(?:de\s+)?conducir|f[üu]hrerschein)\s*[:\-#]?\s*(DL-[A-Z]\d{4,6}-\d{2,4}|[A-Z]\d{4,15}|\d{1,3}-\d{2,4}-\d{4,6})\b", 0.80, 1, flags=I),
    Spec("DRIVERS_LICENSE", r"\bDL-[A-Z]\d{4,6}-\d{2,4}\b", 0.82, flags=I),
    Spec("PASSPORT", r"\b(?:passport)\s*(?:number|no|#)?\s*[:\-#]?\s*([A-Z][A-Z0-9]{5,11})\b", 0.82, 1, flags=I),
    Spec("ROUTING_NUMBER", r"\b(?:routing|ABA|transit)\s*(?:number|no|#)?\s*[:\-#]?\s*(\d{9})\b", 0.83, 1, validator="aba_routing", tiers=(0.93, 0.83), flags=I),
    Spec("LICENSE_PLATE", r"\b(?:plate|license\s*plate|tag|vehicle\s*(?:registration|reg)|registration\s*number)\s*(?:number|no|#)?\s*[:\-#]?\s*([A-Z0-9]{1,4}[\s\-]?[A-Z0-9]{2,5})\b", 0.78, 1, flags=I),
    Spec("LICENSE_PLATE", r"\b(?:plate|license|tag|vehicle|registration|reg)\s*(?:number|no|#)?\s*[:\-#]?\s*([A-Z]{1,3}[\s\-]?\d{1,4}[\s\-]?[A-Z]{0,3})\b", 0.75, 1, flags=I),
    Spec("CREDIT_CARD_FRAGMENT", r"(?:card\s+ending\s+(?:in\s+|with\s+)?|card\s+ends\s+(?:in|with)\s+|card\s+last\s+(?:four|4)\s*(?:digits?)?\s*[:\-]?\s*|card\s*#?\s*(?:\*+|x+|\.+)\s*)(\d{4})\b", 0.88, 1, flags=I),
    Spec("BANK_ACCOUNT", r"\b(?:account|acct|bank\s*account)\s*(?:number|no|#)?\s*[:\-#]?\s*(\d{8,17})\b", 0.79, 1, flags=I),
    Spec("NATIONAL_ID", r"\b(?:national\s*id|national\s*identification|citizen\s*id|ID\s*number|(?:international\s+)?tax\s+id)\s*[:\-#]?\s*((?:NID|TAX)-\d{6,15}|[A-Z0-9]{5,20})\b", 0.78, 1, flags=I),
    Spec("USERNAME", r"(?<!\w)@([A-Za-z][A-Za-z0-9._-]{2,30})(?!\w)", 0.82, needs="@"),
    Spec("USERNAME", r"(?:\b(?:username|user\s*name|login|handle|screen\s*name|User|email\s+handle)|\"db_user\"|\"user_id\"|\"login_id\")\s*(?:is|[:\-=])?\s*[\"']?\s*([A-Za-z][A-Za-z0-9._-]{2,30})\b", 0.80, 1, flags=I),
    Spec("EMPLOYEE_ID", r"\b(?:employee\s*(?:id|number|#|no)|staff\s*(?:id|number|#)|emp\s*(?:#|id)|personnel\s*(?:id|number|#)|badge\s*(?:number|#|id))\s*[:\-#]?\s*(EMP-?\d{3,10}|\d{4,10})\b", 0.75, 1, context="EMPLOYEE_ID", flags=I),
    Spec("EMPLOYEE_ID", r"\b(EMP-\d{3,10})\b", 0.80, 1, flags=I),
    Spec("MEDICAL_RECORD_NUMBER", r"\b(?:MRN|medical\s*record|patient\s*id|medical\s*id|health\s*id|national\s+health\s+id)\s*(?:number|no|#)?\s*[:\-#]?\s*([A-Z]{0,4}-?[A-Z0-9]{4,20})\b", 0.82, 1, flags=I),
    Spec("ORGANIZATION", r"\b([A-Z][A-Za-z&'.]+(?:\s+[A-Z][A-Za-z&'.]+)*)\s+(?:Inc|Corp|Corporation|LLC|Ltd|Limited|GmbH|AG|PLC|Co|Company|Group|Foundation|Association)\.?\b", 0.80, deny=True),
    Spec("ORGANIZATION", r"\b([A-Z][A-Za-z&'.]+(?:\s+[A-Z][A-Za-z&'.]+)*\s+(?:Industries|Systems|Technologies|Labs|Laboratories|Enterprises|Solutions|Dynamic|Dynamics|Communications|Electronics|Pharmaceuticals|Consulting|Partners|Robotics|Aerospace|Digital|Analytics|Software|Networks|Services|Media|Capital|Holdings|Ventures|International|Global|Medical|Health|Bio|Biotech|Energy|Power|Financial|Insurance|Logistics|Transport|Motors|Aviation|Construction|Engineering|Security|Defense|Research))\b", 0.78, 1, deny=True),
    Spec("ORGANIZATION", r"\b(?:Company|Organisation|Organization|Employer|Unternehmen|Empresa|Entreprise|Azienda|Bedrijf|Företag|Virksomhed|Firma|Yritys|Organisasjon|Organizacja|employed\s+(?:at|by)|works?\s+(?:at|for)|affiliated\s+with|belongs?\s+to)\s*[:\-]?\s*([A-Z][A-Za-z&'.]+(?:\s+[A-Z][A-Za-z&'.]+){0,4})\b", 0.80, 1, deny=True, flags=I),
    Spec("ADDRESS", r"\b(\d{1,6}\s+(?:[A-Z][a-z]+\s+){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Court|Ct|Place|Pl|Circle|Cir|Terrace|Ter|Trail|Trl|Highway|Hwy|Parkway|Pkwy)\.?(?:,?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,?\s+[A-Z]{2}\s+\d{5}(?:-\d{4})?)?)\b", 0.82, 1, flags=I),
    Spec("LOCATION", r"\b(?:city|location|located\s+in|residing\s+in|based\s+in|from)\s*[:\-]?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b", 0.60, 1, deny=True),
    Spec("LOCATION", r"\bAddr:\s+[^,]+,\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\s+[A-Z]{2}\b", 0.65, 1),
    Spec("LOCATION", r"[^,]+,\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}),\s+[A-Z]{2}\s+\d{5}\s+\(near\s+", 0.65, 1),
    Spec("LOCATION", r"\bnear\s+([A-Z][a-z]+)\b", 0.58, 1),
    Spec("CRYPTO_WALLET", r"\b([13][a-km-zA-HJ-NP-Z1-9]{25,34})\b", 0.95, 1),
    Spec("CRYPTO_WALLET", r"\b(bc1[a-z0-9]{39,59})\b", 0.95, 1),
    Spec("CRYPTO_WALLET", r"\b(0x[a-fA-F0-9]{40})\b", 0.97, 1, needs="0x"),
    Spec("GPS_COORDINATES", r"(?<![0-9.])(-?(?:90(?:\.0+)?|[0-8]?\d(?:\.\d+)?))\s*[,/]\s*(-?(?:180(?:\.0+)?|1[0-7]\d(?:\.\d+)?|\d{1,2}(?:\.\d+)?))(?![0-9.])", 0.88, validator="gps"),
    Spec("SWIFT_BIC", r"\b([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b", 0.85, 1, validator="swift_context"),
    Spec("VIN", r"\b([A-HJ-NPR-Z0-9]{17})\b", 0.80, 1, validator="vin", tiers=(0.93, 0.80)),
    Spec("ZIP_CODE", r"\b(?:zip\s*(?:code)?|postal\s*code)\s*[:\-#]?\s*(\d{5}(?:-\d{4})?)\b", 0.90, 1, flags=I),
    Spec("CANADIAN_SIN", r"\b(?:SIN|social\s+insurance)\s*(?:number|no|#)?\s*[:\-#]?\s*(\d{3}[-\s]?\d{3}[-\s]?\d{3})\b", 0.75, 1, validator="sin_luhn", tiers=(0.92, 0.75), flags=I),
    Spec("UK_NI_NUMBER", r"\b([A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D])\b", 0.89, 1, validator="uk_ni", tiers=(0.95, 0.0)),
    Spec("JWT_TOKEN", r"\b(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})\b", 0.95, 1, needs="eyJ"),
    Spec("API_KEY", r"\b(?:api[_\s]?key|api[_\s]?token|bearer|access[_\s]?token|secret[_\s]?key)\s*[:\-=]\s*([A-Za-z0-9_\-]{32,})\b", 0.91, 1, flags=I),
    Spec("AADHAAR", r"\b(?:aadhaar|aadhar|uid)\s*(?:number|no|#)?\s*[:\-#]?\s*(\d{4}[-\s]?\d{4}[-\s]?\d{4})\b", 0.80, 1, validator="aadhaar", tiers=(0.91, 0.80), flags=I),
    Spec("URL_WITH_PII", r"\bhttps?://[^\s]+(?:[?&](?:email|user|ssn|name|phone|account)=[^\s&]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 0.87, needs="http", flags=I),
    Spec("AGE", r"\b(?:age[d]?\s+(\d{1,3})|(\d{1,3})[-\s]?years?[-\s]?old)\b", 0.82, validator="age", context="AGE", flags=I),
    Spec("MEDICAL_LICENSE", r"\b(?:NPI|national\s+provider)\s*(?:identifier|number|no|#|id)?\s*[:\-#]?\s*(\d{10})\b", 0.88, 1, validator="npi", context="MEDICAL_LICENSE", flags=I),
    Spec("MEDICAL_LICENSE", r"\b(?:DEA)\s*(?:number|no|#|registration)?\s*[:\-#]?\s*([A-Za-z]{2}\d{7})\b", 0.88, 1, validator="dea", context="MEDICAL_LICENSE", flags=I),
    Spec("NATIONAL_ID", r"\bNID[-]?\d{9,12}\b", 0.88, context="NATIONAL_ID"),
    Spec("US_SSN", r"\b9\d{2}-\d{2}-\d{4}\b", 0.90, context="US_SSN"),
    Spec("US_SSN", r"\b9\d{2}\s\d{2}\s\d{4}\b", 0.85, context="US_SSN"),
    Spec("PHONE_NUMBER", r"\+1\s*\(\d{3}\)\s*\d{3}[-.\s]\d{4}\b", 0.92, context="PHONE_NUMBER"),
    Spec("PHONE_NUMBER", r"\+\d{1,3}\s+\d{2,4}[-.\s]\d{3}[-.\s]\d{3,4}\b", 0.88, context="PHONE_NUMBER"),
    Spec("PHONE_NUMBER", r"\+44\s+\d{2}\s+\d{4}\s+\d{4}\b", 0.90, context="PHONE_NUMBER"),
    Spec("DATE_OF_BIRTH", rf"\b(?:born|DOB|date\s+of\s+birth|birth\s*date|d\.o\.b\.?|fecha\s+de\s+nacimiento)\s*[?:\-/]*\s*(?:A:\s*)?({ANY_DATE})\b", 0.87, 1, context="DATE_OF_BIRTH", flags=I),
    Spec("CVV", r"\b(?:cvv|cvv2|cvc|cvc2|cid|security\s*code|card\s*verification(?:\s*value)?)(?:\s*(?:number|no|#|is|:|=|-)){0,2}\s*(\d{3,4})\b", 0.92, 1, flags=I),
    Spec("PIN", r"\b(?:pin(?:\s*(?:number|code))?|passcode|atm\s*pin|pin\s*#)(?:\s*(?:is|:|=|-)){0,2}\s*(\d{4,6})\b", 0.90, 1, flags=I),
    Spec("PASSWORD", r"(?:^|[\s;,])(?:password|passwd|pwd|pass)\s*[:=]\s*([^\s'\";,]{6,64})", 0.92, 1, flags=I),
    Spec("COURT_CASE_NUMBER", rf"\b(?:case\s*(?:no\.?|number|#)|no\.)\s*({CASE}|\d{{2,3}}-\d{{3,8}})\b", 0.90, 1, flags=I),
    Spec("DOCKET_NUMBER", rf"\b(?:docket\s*(?:no\.?|number|#)?)\s*[:\-]?\s*({CASE}|[A-Z]{{1,4}}-\d{{3,8}})\b", 0.90, 1, flags=I),
    Spec("BAR_NUMBER", r"\b(?:state\s+bar|sbn|bar\s*(?:id|no\.?|number|#))\s*[:\-#]?\s*(\d{4,8})\b", 0.90, 1, flags=I),
    Spec("INVOICE_NUMBER", r"\b(?:invoice|inv\.?)\s*(?:no\.?|number|#)?\s*[:\-#]?\s*([A-Z]{0,4}[-/]?\d{3,10}(?:[-/]\d{1,6})?)\b", 0.90, 1, flags=I),
    Spec("INSURANCE_POLICY_NUMBER", r"\b(?:policy|policyholder|insurance\s*policy)\s*(?:no\.?|number|#)?\s*[:\-#]?\s*([A-Z]{0,6}[-/]?\d{4,10}(?:[-/][A-Z0-9]{1,6})?)\b", 0.90, 1, flags=I),
    Spec("SALARY", r"\b(?:salary|annual\s*salary|compensation|base\s*pay|earnings|wage)\s*(?:of|:|is|was|=|-)?\s*\$?(\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d{4,10}(?:\.\d{1,2})?)(?:\s*(?:per|/)\s*(?:year|yr|annum|month|mo))?\b", 0.90, 1, flags=I),
)

#: Types that the full pipeline drops unless it is told to keep them.
UNSUPPORTED = ("SWIFT_BIC", "ZIP_CODE", "CANADIAN_SIN", "UK_NI_NUMBER", "JWT_TOKEN", "API_KEY", "AADHAAR", "URL_WITH_PII")
TYPES = tuple(dict.fromkeys(s.entity_type for s in REGISTRY))
SUPPORTED = tuple(t for t in TYPES if t not in UNSUPPORTED)
