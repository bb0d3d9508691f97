"""Fixed values shared by the rules, the repairs and the reports."""

# The words that stand for "no value" after a repair.
UNKNOWN = "UNKNOWN"
UNKNOWN_GENDER = "U"
INVALID_FORMAT = "INVALID_FORMAT"
MISSING_FK = "MISSING_FK"

# Texts (trimmed, lower-cased) that count as empty in integrity work.
EMPTY_TEXTS = ("", "0000", "unknown", "n/a")

# Formats.
UUID_PATTERN = r"^[A-Fa-f0-9]{8}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{12}$"
CODE_PATTERN = r"^[A-Za-z0-9\.\-]+$"
DIGITS_PATTERN = r"^[0-9]+$"
DASHED_PATTERN = r"^[A-Za-z0-9-]+$"

# Dimension labels of the profile.
COMPLETENESS = "Pilnīgums (Completeness)"
UNIQUENESS = "Unikalitāte (Uniqueness)"
ACCURACY = "Precizitāte (Accuracy)"
TIMELINESS = "Savlaicīgums (Timeliness)"
VALIDITY = "Derīgums (Validity)"
INTEGRITY = "Starptabulu integritāte"

# The wording of the profile's findings, and the name of no domain.
EMPTY_VALUE = "Null vai tukšas vērtības"
BAD_GENDER = "Nederīgs dzimums"
BAD_DATE = "Nederīgs datums"
DIED_EARLY = "Nāves datums pirms dzimšanas"
STOPPED_EARLY = "STOP pirms START"
BAD_FORMAT = "Nederīgs formāts"
REPEATED_ROWS = "Rindu dublikāti"
UNDETERMINED = "Nenoteikts"

# Dimension codes of validation, correction and re-assessment,
# with the names the summary report shows for them.
DIMENSION_NAMES = {
    "5DD": "Datu Domēna Noteikšana",
    "5MD": "Metadatu Definīcija",
    "5SV": "Shēmas Validācija",
    "6V": "Apjoma Pārbaudes",
    "7S": "Sintaktiskā Validācija",
    "8BL": "Biznesa Loģikas Validācija",
    "8RI": "Atsauces Integritāte (Pirms Labošanas)",
    "9S": "Semantiskā/Ontoloģiskā Validācija",
    "10CL": "Klīniskās Loģikas Pārbaudes",
    "11FI": "Trūkstošo Lauku Aizpildīšana",
    "12C": "Pilnīgums (Pirms Labošanas)",
    "12T": "Savlaicīgums (Pirms Labošanas)",
    "15C": "Datu Labošana",
    "15DS": "Datu Saglabāšana HDFS",
    "17PC_C": "Pilnīgums (Pēc Labošanas)",
    "17PC_U": "Unikalitāte (Pēc Labošanas)",
    "17PC_A": "Precizitāte (Pēc Labošanas)",
    "17PC_V": "Derīgums/Apjoms (Pēc Labošanas)",
    "17PC_T": "Savlaicīgums (Pēc Labošanas)",
    "17PC_RI": "Atsauces Integritāte (Pēc Labošanas)",
}

# Error share (percent) at which a cell is recommended / warning / critical.
SEVERITY_LEVELS = ((10.0, "critical"), (5.0, "warning"), (1.0, "recommended"))

# What a metric row says about its own measurement.
CHECKED = "checked"
SKIPPED = "skipped"
EMPTY = "empty"
FAILED = "failed"
