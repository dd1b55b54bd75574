"""Every literal that the data dictates: codes, labels, lists, patterns and cut-offs.

All values in this module are FIXED VALUES: they are part of the data format or
of the published label set, so results are only right if they equal it.
"""

from __future__ import annotations

from decimal import Decimal

# --- fixed values: raw file format -----------------------------------------
MISSING = "null"
DATE_PATTERN = "d.M.yyyy"
FIELD_SEPARATOR = ";"
QUOTE = '"'
ENCODING = "UTF-8"
KEY_SEPARATOR = "||"
LOCATION_SEPARATOR = ", "
ABSENT_PATTERN = "%не з%яв%"
UUID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
TOWN_PREFIX = r"(?U)^м\.\s*"
TOWN_PREFIX_ANY_CASE = r"(?iuU)^м\.\s*"

# --- fixed values: subjects -------------------------------------------------
# code, name, mandatory, column prefix, exam language (None: read from the record)
SUBJECT_ROWS = (
    ("Ukr", "Ukrainian Language", True, "ukr", "українська"),
    ("Hist", "History of Ukraine", True, "hist", None),
    ("Math", "Mathematics", True, "math", None),
    ("Phys", "Physics", False, "phys", None),
    ("Chem", "Chemistry", False, "chem", None),
    ("Bio", "Biology", False, "bio", None),
    ("Geo", "Geography", False, "geo", None),
    ("Eng", "English Language", False, "eng", "англійська"),
    ("Fra", "French Language", False, "fra", "французька"),
    ("Deu", "German Language", False, "deu", "німецька"),
    ("Spa", "Spanish Language", False, "spa", "іспанська"),
    ("UkrLit", "Ukrainian Literature", False, "ukrlit", "українська"),
)

# --- fixed values: participant attributes ----------------------------------
STATUS_CURRENT_YEAR = "Випускник поточного року"
STATUS_PREVIOUS_YEARS = "Випускник минулих років"
STATUS_PENITENTIARY = "Установа виконання покарань"
WOMEN = "жіноча"
MEN = "чоловіча"

TERRITORY_ABROAD = "інша країна"
TERRITORY_CITY = "місто"
TERRITORY_VILLAGE = "селище, село"

LOCATION_ABROAD = "Закордон"
LOCATION_CITY = "Місто"
LOCATION_VILLAGE = "Село"
UNDEFINED = "Не визначено"

# --- fixed values: regional centres ----------------------------------------
CAPITAL_REGION_SPELLINGS = ("м.Київ", "м. Київ")
CAPITAL_AS_REGION = "м.Київ"
CAPITAL_HOME_REGION = "Київська область"
CENTRE_DISTRICTS = (
    "Київ", "Дніпро", "Житомир", "Запоріжжя", "Кропивницький", "Львів",
    "Миколаїв", "Одеса", "Полтава", "Суми", "Харків", "Херсон", "Черкаси",
    "Чернігів", "Донецьк", "Луганськ",
)
CENTRE_TOWNS = (
    "Вінниця", "Луцьк", "Ужгород", "Івано-Франківськ", "Рівне", "Тернопіль",
    "Хмельницький", "Чернівці", "Донецьк", "Луганськ",
)
AMBIGUOUS_TOWN = "Миколаїв"
AMBIGUOUS_TOWN_REGION = "Миколаївська область"

# --- fixed values: calendar labels -----------------------------------------
SESSION_PHASES = {
    5: "Травневі суботні сесії",
    6: "Червнева основна сесія",
    7: "Липнева додаткова сесія",
}
WEEKDAYS = {
    1: "Понеділок",
    2: "Вівторок",
    3: "Середа",
    4: "Четвер",
    5: "П'ятниця",
    6: "Субота",
    7: "Неділя",
}

# --- fixed values: score scale and cut-offs --------------------------------
FAILED_SCORE = Decimal("0.0")
HIGH_SCORE = Decimal("180")
RISK_BELOW = Decimal("130")
UNIVERSAL_FROM = Decimal("160")
PROFILE_FROM = Decimal("140")
ASYMMETRY = Decimal("15")
MIN_STUDENTS_PER_TYPE = 50
MIN_STUDENTS_PER_SCHOOL = 10

# --- fixed values: region classes by concentration quotient ----------------
REGION_CLASSES = (
    (Decimal("1.8"), "Гіпермоноцентрична"),
    (Decimal("1.4"), "Високоцентралізована"),
    (Decimal("1.0"), "Помірно централізована"),
)
REGION_BALANCED = "Поліцентрична / Збалансована"

# --- fixed values: school ranks --------------------------------------------
SCHOOL_POLARISED = "Поляризована школа"
SCHOOL_FLAGSHIP = "Флагманська школа"
SCHOOL_TYPICAL = "Типова сільська школа"

# --- fixed values: archetypes ----------------------------------------------
ARCHETYPE_RISK = "Академічна група ризику"
ARCHETYPE_UNIVERSAL = "Академічний універсал"
ARCHETYPE_STEM = "STEM-спеціаліст"
ARCHETYPE_HUMANITIES = "Гуманітарний профіль"
ARCHETYPE_BALANCED = "Збалансований базовий рівень"

# --- fixed values: sets used by the second-order statistics ----------------
LANGUAGE_DAYS = ("2025-06-02", "2025-06-05", "2025-06-12", "2025-06-16", "2025-06-18")
MASS_DAYS = (
    "2025-06-03", "2025-06-04", "2025-06-06", "2025-06-09", "2025-06-10",
    "2025-06-11", "2025-06-13", "2025-06-17", "2025-06-19",
)
REFUGE_ELECTIVES = ("Geo", "Bio", "UkrLit")
STEM_ELECTIVES = ("Phys", "Chem")
