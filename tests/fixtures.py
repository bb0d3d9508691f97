"""Five small tables; the comments say what is wrong with a row."""

AS_OF = "2024-06-30"


def pid(n: int) -> str:
    return f"ac000000-0000-4000-8000-{n:012d}"


def eid(n: int) -> str:
    return f"bd000000-0000-4000-8000-{n:012d}"


PATIENTS = [
    # Id, BIRTHDATE, DEATHDATE, SSN, DRIVERS, FIRST, GENDER
    (pid(1), "1980-03-05", "2010-01-01", "999-12-3456", "S99-1", " Ann ", "F"),
    (pid(2), "2020-03-05", "2020-03-04", "999123456", "S 99", "Bob", "M"),  # dead before birth; bad licence
    (pid(3), "2016-02-29", None, "12", None, "Cyd", None),  # no gender
    (pid(4), "02/14/1950", None, "", "S99-4", "Dan", "X"),  # US date, empty number, X
    (pid(5), "1960.07.08", "2030-01-01", "abc", "###", "Eve", "U"),  # dotted date, death in the future
    (pid(6), "2031-01-01", None, "1-2", "S99-6", "Fay", "m"),  # born in the future
    (pid(7), "INVALID", None, "999", "S99-7", "Gus", "M"),  # no date at all
    (pid(7), "INVALID", None, "999", "S99-7", "Gus", "M"),  # the same row again
    (None, None, None, None, None, "", "F"),  # no key, no date, empty name
]
PATIENT_COLUMNS = "Id string, BIRTHDATE string, DEATHDATE string, SSN string, DRIVERS string, FIRST string, GENDER string"

ENCOUNTERS = [
    # ID, START, STOP, PATIENT, CODE
    (eid(1), "2009-05-01T10:00:00Z", "2009-05-01T11:00:00Z", pid(1), "185345009"),
    (eid(2), "2021-01-02T10:00:00Z", "2021-01-01T10:00:00Z", pid(2), "A.1-b"),  # stops before it starts
    (eid(3), "INVALID", "2021-01-01", "BAD", "XXX 1"),  # three defects
    (eid(4), None, None, None, "1"),  # three NULLs
    (eid(5), "2023-01-01", "2023-02-01", pid(99), "2"),  # no such patient
    ("bad-" + eid(6), "2023-01-01", "2023-02-01", pid(3).upper(), "3"),  # prefix; key in capitals
    (eid(1), "2009-05-01T10:00:00Z", "2009-05-01T11:00:00Z", pid(2), "185345009"),  # id again, other patient
    (eid(4), None, None, pid(4), "1"),  # id again, this time with a patient
]
ENCOUNTER_COLUMNS = "ID string, START string, STOP string, PATIENT string, CODE string"

CONDITIONS = [
    # START, STOP, PATIENT, ENCOUNTER, CODE, DESCRIPTION
    ("2009-05-01", "2009-06-01", pid(1), eid(1), "279039007", "Chronic neck pain (finding)"),
    ("2021-01-01", "01/02/2021", pid(2), eid(2), "72892002", "Normal PREGNANCY"),  # a man; code unknown; European date
    ("2021-01-01", "2021.02.01", None, eid(1).upper(), None, "chronic neck pain"),  # key through encounter 1
    ("2021-01-01", "soon", None, "0000", "XXX123", "Stress (finding)"),  # no detour; unreadable date
    ("2021-01-01", None, pid(3), eid(5), "44054006", "Diabetes: type 2 diabetes mellitus"),  # born after 2015
    ("2021-01-01", "20200101", pid(99), eid(4), "1", "  Acute deep venous thrombosis (disorder) "),  # via encounter 4
    ("2021-01-01", "2022-01-01", pid(2).upper(), eid(77), "n/a", None),  # key in capitals, no such encounter
    ("2021-01-01", "2022-01-01", None, None, "", "x"),
]
CONDITION_COLUMNS = "START string, STOP string, PATIENT string, ENCOUNTER string, CODE string, DESCRIPTION string"

MEDICATIONS = [
    # START, STOP, PATIENT, ENCOUNTER, CODE
    ("2009-01-01T00:00:00Z", "2009-02-01", pid(1), eid(1), "1"),
    ("2011-01-01T00:00:00Z", "2012-01-01", pid(1), eid(1), "1"),  # after death
    (None, None, None, eid(2), "2"),
    ("20230101", "2023.01.02", pid(2), None, "3"),
    ("tomorrow", "01/02/2023", "unknown", "n/a", "4"),
]
MEDICATION_COLUMNS = "START string, STOP string, PATIENT string, ENCOUNTER string, CODE string"

ALLERGIES = [
    # START, STOP, PATIENT, ENCOUNTER, CODE, TYPE
    ("2009-01-01", None, pid(1), eid(1), "1", "allergy"),
    ("2015-01-01", "2014-12-31", pid(1), eid(1), "1", None),  # after death; stops before it starts
    ("2016-01-01", None, None, eid(3), "1", "UNKNOWN"),  # the detour leads to BAD
]
ALLERGY_COLUMNS = "START string, STOP string, PATIENT string, ENCOUNTER string, CODE string, TYPE string"


def tables(spark):
    return {
        "patients": spark.createDataFrame(PATIENTS, PATIENT_COLUMNS),
        "encounters": spark.createDataFrame(ENCOUNTERS, ENCOUNTER_COLUMNS),
        "conditions": spark.createDataFrame(CONDITIONS, CONDITION_COLUMNS),
        "medications": spark.createDataFrame(MEDICATIONS, MEDICATION_COLUMNS),
        "allergies": spark.createDataFrame(ALLERGIES, ALLERGY_COLUMNS),
    }


def errors(metrics, *key):
    """(error_count, total_count) by the named columns; a key may occur once only."""
    key = key or ("table_name", "quality_dimension", "rule_name")
    out = {}
    for r in metrics.collect():
        k = tuple(r[c] for c in key)
        assert k not in out or len(key) < 3 or "issue_description" not in key, k
        out.setdefault(k, []).append((r["error_count"], r["total_count"]))
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}
