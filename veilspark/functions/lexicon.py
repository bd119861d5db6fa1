"""Word lists and tables.  Fixed values that results must equal."""

from __future__ import annotations

#: Words that back up a type when they stand near a match: those that a word of Latin letters can equal.
CONTEXT_WORDS: dict[str, str] = {
    "US_SSN": "social security ssn tax tin taxpayer identification",
    "CREDIT_CARD": "credit card visa mastercard amex discover payment debit charge cc cardnumber tarjeta crédito credito carte crédit kreditkarte karte cartão",
    "PHONE_NUMBER": "call phone tel telephone mobile fax cell contact reach cellphone teléfono telefono móvil movil téléphone portable telefon handy mobilnummer telefone",
    "EMAIL_ADDRESS": "email mail contact send address correo electrónico electronico courriel correio",
    "IP_ADDRESS": "ip host server network",
    "IBAN": "iban bank transfer wire international bic",
    "PERSON_NAME": "name person patient employee client member user resident beneficiary customer nombre persona paciente empleado cliente nom personne employé employe mitarbeiter kunde nome pessoa funcionário funcionario",
    "AGE": "age aged years old born birthday",
    "MEDICAL_LICENSE": "npi dea license provider physician prescriber",
    "DATE_OF_BIRTH": "born birth dob birthday birthdate date nacimiento naissance",
    "NATIONAL_ID": "national identity id identification cedula dni citizen",
    "EMPLOYEE_ID": "employee emp staff personnel worker badge payroll contractor",
}

#: Types whose confidence drops where no such word is near.
PENALISED = (
    "US_SSN", "PERSON_NAME", "LOCATION", "ORGANIZATION", "ADDRESS", "PHONE_NUMBER", "EMPLOYEE_ID", "IP_ADDRESS",
    "EMAIL_ADDRESS", "CREDIT_CARD_FRAGMENT", "BANK_ACCOUNT", "VIN", "LICENSE_PLATE", "NATIONAL_ID",
)

DENY: dict[str, str] = {
    "PERSON_NAME": (
        "new york|san francisco|los angeles|united states|north america|south america|east coast|west coast|great britain|new zealand|south africa|north korea|"
        "south korea|united kingdom|hong kong|el salvador|costa rica|puerto rico|sri lanka|saudi arabia|dominican republic|czech republic|ivory coast|"
        "sierra leone|burkina faso|papua new guinea|trinidad and tobago|antigua and barbuda|saint lucia|cape verde|san marino|east timor|"
        "marshall islands|solomon islands|equatorial guinea|central african republic|bosnia and herzegovina|"
        "las vegas|san diego|san jose|san antonio|santa monica|santa cruz|santa barbara|santa fe|el paso|fort worth|grand rapids|little rock|"
        "long beach|palm springs|park city|salt lake|baton rouge|corpus christi|des moines|ann arbor|cedar rapids|palo alto|monte carlo|monte vista|"
        "palm beach|virginia beach|daytona beach|west palm|west point|north pole|tel aviv|buenos aires|kuala lumpur|rio de janeiro|sao paulo|ho chi minh|"
        "addis ababa|dar es salaam|port au prince|la paz|el cairo|abu dhabi|new delhi|st petersburg|st louis|"
        "high school|public school|middle school|real estate|ice cream|black friday|good morning|good afternoon|good evening|happy birthday|merry christmas|"
        "happy new|first name|last name|full name|social security|credit card|phone number|email address|date birth|blood type|health care|mental health|"
        "public health|law enforcement|prime minister|vice president|chief executive|general manager|board directors|human resources|customer service|"
        "data protection|privacy policy|terms service|machine learning|artificial intelligence|deep learning|natural language|open source|best practice|"
        "high quality|long term|short term|real time|next step|action item|follow up|support ticket|case number|case no|account number|account holder|"
        "account manager|project manager|product manager|program manager|technical support|customer support|help desk|system administrator|"
        "network administrator|quality assurance|business analyst|information technology|information security|risk management|compliance officer|"
        "hello mr|hello mrs|hello ms|hello dr|dear sir|dear madam|test user|sample data|john doe|jane doe|foo bar|lorem ipsum|hello world|test case|"
        "test data|dummy data|oscorp technologies|massive dynamic|pied piper inc|prestige worldwide|wayne enterprises|weyland industries|"
        "hooli technologies|stark labs|sterling cooper|soylent inc|globex industries|vandelay industries|cyberdyne systems|dunder mifflin|"
        "aperture science|umbrella group|tyrell corporation|acme corp|initech llc|ash place|birch court|oak drive|elm street|maple avenue|pine road|"
        "cedar lane|investigation report|current address|bar license|discharge summary|primary subject|audit period|traumatic stress disorder|"
        "applicant mr|applicant mrs|defendant mr|defendant mrs|mr.|mrs.|ms."
    ),
    "LOCATION": (
        "high school|public school|middle school|real estate|ice cream|health care|first name|last name|next step|open source|machine learning|"
        "deep learning|best practice|good morning|good evening"
    ),
}

ADDRESS_ENDS = "street st avenue ave road rd way boulevard blvd lane ln circle terrace drive dr"
HONORIFICS = "mr mrs ms dr prof sir rev"

#: ISO 3166-1 two-letter codes.
COUNTRIES = (
    "AD AE AF AG AI AL AM AO AQ AR AS AT AU AW AX AZ BA BB BD BE BF BG BH BI BJ BL BM BN BO BQ BR BS BT BV BW BY BZ CA CC CD CF CG CH CI CK CL CM CN CO CR CU CV CW CX CY "
    "CZ DE DJ DK DM DO DZ EC EE EG EH ER ES ET FI FJ FK FM FO FR GA GB GD GE GF GG GH GI GL GM GN GP GQ GR GS GT GU GW GY HK HM HN HR HT HU ID IE IL IM IN IO IQ IR IS IT "
    "JE JM JO JP KE KG KH KI KM KN KP KR KW KY KZ LA LB LC LI LK LR LS LT LU LV LY MA MC MD ME MF MG MH MK ML MM MN MO MP MQ MR MS MT MU MV MW MX MY MZ NA NC NE NF NG NI "
    "NL NO NP NR NU NZ OM PA PE PF PG PH PK PL PM PN PR PS PT PW PY QA RE RO RS RU RW SA SB SC SD SE SG SH SI SJ SK SL SM SN SO SR SS ST SV SX SY SZ TC TD TF TG TH TJ TK "
    "TL TM TN TO TR TT TV TW TZ UA UG UM US UY UZ VA VC VE VG VI VN VU WF WS YE YT ZA ZM ZW"
)

NAMES: dict[str, tuple[str, str]] = {
    "en": (
        "Alex Jordan Taylor Morgan Casey Riley Quinn Avery Harper Parker Drew Logan Sage Cameron Emerson Hayden Rowan Ellis Finley Blake Oakley Skyler Reese Dakota Phoenix Adrian Sawyer River Marlowe Lennox Remington Sterling",
        "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Anderson Taylor Thomas Moore Jackson Martin Lee Thompson White Harris Clark Lewis Walker Hall Young Allen King Wright Scott Green Baker Adams",
    ),
    "es": (
        "Alejandro Sofía Carlos Valentina Diego Camila Mateo Lucía Santiago Isabella Sebastián Mariana Andrés Gabriela Nicolás Paula Daniel Andrea",
        "García Rodríguez Martínez López González Hernández Pérez Sánchez Ramírez Torres Flores Rivera",
    ),
    "fr": (
        "Camille Antoine Manon Lucas Chloé Hugo Léa Gabriel Emma Louis Jade Raphaël Louise Arthur Alice Jules Lina Adam",
        "Martin Bernard Dubois Thomas Robert Richard Petit Durand Leroy Moreau Simon Laurent",
    ),
    "de": (
        "Maximilian Sophie Alexander Marie Paul Emma Leon Hannah Lukas Mia Felix Lena Jonas Anna Tim Laura Ben Lara",
        "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Richter",
    ),
}
CITIES: dict[str, str] = {
    "en": "Springfield|Riverside|Fairview|Georgetown|Clinton|Madison|Salem|Franklin|Greenville|Arlington|Bristol|Ashland|Burlington|Chester|Dayton",
    "es": "San Miguel|Santa Cruz|La Paz|San José|Monterrey",
    "fr": "Saint-Denis|Saint-Étienne|Villeurbanne|Clermont|Nanterre",
    "de": "Neustadt|Friedrichshafen|Waldkirch|Steinbach|Rosenheim",
}
STREETS = "Main St|Oak Ave|Elm Dr|Park Rd|Cedar Ln|Maple Blvd"

#: Detected types' names in the tables of policies and hierarchies.
ALIASES = {
    "CREDIT_CARD": "CREDIT_CARD_NUMBER", "GPS_COORDINATES": "LOCATION_COORDINATES", "DATE_ISO": "DATE", "DATE_TIME": "DATE",
    "PASSPORT": "PASSPORT_NUMBER", "BANK_ACCOUNT": "BANK_ACCOUNT_NUMBER", "NATIONAL_ID": "NATIONAL_ID_NUMBER",
    "VIN": "VEHICLE_IDENTIFICATION_NUMBER", "SWIFT_BIC": "SWIFT_BIC_CODE", "CRYPTO_WALLET": "CRYPTOCURRENCY_WALLET",
}

#: policy -> strategy -> types
POLICIES: dict[str, dict[str, str]] = {
    "hipaa_safe_harbor": {
        "synthetic": "PERSON_NAME",
        "generalize": "ZIP_CODE ADDRESS DATE_OF_BIRTH DATE IP_ADDRESS",
        "tokenize": "MEDICAL_RECORD_NUMBER HEALTH_INSURANCE_ID",
        "redact": "AGE PHONE_NUMBER EMAIL_ADDRESS US_SSN BANK_ACCOUNT_NUMBER CREDIT_CARD_NUMBER DRIVERS_LICENSE VEHICLE_IDENTIFICATION_NUMBER DEVICE_ID URL_WITH_PII BIOMETRIC_ID PRESCRIPTION_NUMBER LICENSE_PLATE PASSPORT_NUMBER NATIONAL_ID_NUMBER",
    },
    "gdpr_pseudonymization": {
        "tokenize": "PERSON_NAME EMAIL_ADDRESS PHONE_NUMBER ADDRESS ZIP_CODE DATE_OF_BIRTH US_SSN PASSPORT_NUMBER DRIVERS_LICENSE NATIONAL_ID_NUMBER CREDIT_CARD_NUMBER BANK_ACCOUNT_NUMBER IBAN ROUTING_NUMBER TAX_ID MEDICAL_RECORD_NUMBER HEALTH_INSURANCE_ID EMPLOYEE_ID IP_ADDRESS MAC_ADDRESS DEVICE_ID URL_WITH_PII SOCIAL_MEDIA_HANDLE USERNAME BIOMETRIC_ID LOCATION_COORDINATES SALARY AGE",
    },
    "gdpr_anonymization": {
        "synthetic": "PERSON_NAME EMAIL_ADDRESS PHONE_NUMBER ADDRESS ZIP_CODE DATE_OF_BIRTH CREDIT_CARD_NUMBER DATE",
        "redact": "US_SSN PASSPORT_NUMBER DRIVERS_LICENSE NATIONAL_ID_NUMBER BANK_ACCOUNT_NUMBER IBAN ROUTING_NUMBER TAX_ID MEDICAL_RECORD_NUMBER HEALTH_INSURANCE_ID BIOMETRIC_ID API_KEY AUTHENTICATION_TOKEN SOCIAL_MEDIA_HANDLE USERNAME DEVICE_ID MAC_ADDRESS PRESCRIPTION_NUMBER LICENSE_PLATE VEHICLE_IDENTIFICATION_NUMBER SWIFT_BIC_CODE CRYPTOCURRENCY_WALLET URL_WITH_PII",
        "generalize": "AGE SALARY IP_ADDRESS",
        "perturb": "LOCATION_COORDINATES",
    },
    "ccpa_deidentification": {
        "synthetic": "PERSON_NAME EMAIL_ADDRESS PHONE_NUMBER",
        "generalize": "ADDRESS ZIP_CODE DATE_OF_BIRTH AGE IP_ADDRESS LOCATION_COORDINATES SALARY",
        "redact": "US_SSN CREDIT_CARD_NUMBER BANK_ACCOUNT_NUMBER",
        "tokenize": "DRIVERS_LICENSE",
    },
    "minimal_risk": {
        "redact": "US_SSN PASSPORT_NUMBER CREDIT_CARD_NUMBER IBAN BANK_ACCOUNT_NUMBER MEDICAL_RECORD_NUMBER HEALTH_INSURANCE_ID BIOMETRIC_ID TAX_ID DRIVERS_LICENSE NATIONAL_ID_NUMBER API_KEY AUTHENTICATION_TOKEN",
    },
    "maximum_privacy": {
        "redact": "PERSON_NAME EMAIL_ADDRESS PHONE_NUMBER ADDRESS ZIP_CODE DATE_OF_BIRTH DATE AGE GENDER NATIONALITY US_SSN PASSPORT_NUMBER DRIVERS_LICENSE NATIONAL_ID_NUMBER VISA_NUMBER LICENSE_PLATE VEHICLE_IDENTIFICATION_NUMBER CREDIT_CARD_NUMBER IBAN BANK_ACCOUNT_NUMBER ROUTING_NUMBER SWIFT_BIC_CODE CRYPTOCURRENCY_WALLET TAX_ID MEDICAL_RECORD_NUMBER HEALTH_INSURANCE_ID PRESCRIPTION_NUMBER MEDICAL_DIAGNOSIS BIOMETRIC_ID IP_ADDRESS MAC_ADDRESS API_KEY AUTHENTICATION_TOKEN DEVICE_ID URL_WITH_PII EMPLOYEE_ID ORGANIZATION JOB_TITLE SALARY EDUCATION_LEVEL LOCATION_COORDINATES ETHNIC_ORIGIN RELIGIOUS_BELIEF POLITICAL_OPINION SOCIAL_MEDIA_HANDLE USERNAME MARITAL_STATUS HOUSEHOLD_SIZE VEHICLE_MODEL",
    },
}

#: experts' strengths by type.
EXPERTS = [
    (expert, kind, strength)
    for expert, table_ in {
        "regex-oss": {
            "EMAIL_ADDRESS": 0.99, "US_SSN": 0.99, "CREDIT_CARD": 0.99, "CREDIT_CARD_FRAGMENT": 0.80, "IP_ADDRESS": 0.99, "MAC_ADDRESS": 0.99, "IBAN": 0.99, "PHONE_NUMBER": 0.95, "DATE_OF_BIRTH": 0.92,
            "DRIVERS_LICENSE": 0.90, "PASSPORT": 0.90, "BANK_ACCOUNT": 0.95, "ROUTING_NUMBER": 0.95, "CRYPTO_WALLET": 0.95, "EMPLOYEE_ID": 0.85, "LICENSE_PLATE": 0.85, "LOCATION": 1.0, "ADDRESS": 0.80,
            "NATIONAL_ID": 0.85, "MEDICAL_RECORD_NUMBER": 0.85, "PERSON_NAME": 0.30, "ORGANIZATION": 0.25, "USERNAME": 0.60,
        },
        "gliner-compatible": {"PERSON_NAME": 0.92, "ORGANIZATION": 0.88, "LOCATION": 0.85, "DATE_OF_BIRTH": 0.80, "PHONE_NUMBER": 0.75, "EMAIL_ADDRESS": 0.70},
        "presidio-compatible": {"PERSON_NAME": 0.82, "PHONE_NUMBER": 0.78, "EMAIL_ADDRESS": 0.80, "LOCATION": 0.75, "DATE_OF_BIRTH": 0.70, "ORGANIZATION": 0.72},
        "scrubadub-compatible": {"EMAIL_ADDRESS": 0.75, "PHONE_NUMBER": 0.60, "US_SSN": 0.55},
        "spacy-ner-compatible": {"PERSON_NAME": 0.78, "ORGANIZATION": 0.72, "LOCATION": 0.75},
        "stanza-ner-compatible": {"PERSON_NAME": 0.75, "ORGANIZATION": 0.68, "LOCATION": 0.72},
    }.items()
    for kind, strength in table_.items()
]
