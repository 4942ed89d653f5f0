from pyspark.sql import functions as F

from mapengine.functions import clean


PHONES = [
    ("(404) 555-1234", "404-555-1234"),
    ("17705551234", "1-770-555-1234"),
    ("678-555-1234 ext 5", "6-785-551-2345"),
    ("404-555-1234; 770-555-1234", "4-045-551-234-770-555-1234"),
    ("7 (0)00", "7000"),
    ("60", "60"),
    ("00", "00"),
    ("0012", "12"),
    ("6", None),
    ("(", None),
    ("", None),
    ("9" * 40, "-".join(["999"] * 13) + "9"),
]


def test_phone_format(column):
    raw, expected = zip(*PHONES, strict=True)
    assert column(clean.phone_format, *raw) == list(expected)


def test_phone_format_agrees_with_the_rule_on_numbers(column):
    numbers = [str(10 ** n + 7 ** n) for n in range(1, 19)]
    rule = [f"{int(n[:-1]):,}".replace(",", "-") + n[-1] for n in numbers]
    assert column(clean.phone_format, *numbers) == rule


SPLITS = [
    ("addr:street", ("addr", "street")),
    ("addr:street:name", ("addr", "street:name")),
    ("a:b:c", ("a", "b:c")),
    ("name:en1", ("name", "en1")),
    ("x:County", ("regular", "x:County")),
    (":foo", ("regular", ":foo")),
    ("", ("regular", "")),
    ("Upper", ("regular", "Upper")),
    ("a1", ("regular", "a1")),
    ("a1:b", ("regular", "a1:b")),
]


def test_split_key(column):
    keys, expected = zip(*SPLITS, strict=True)
    types, names = column(clean.split_key_type, *keys), column(clean.split_key_name, *keys)
    assert list(zip(types, names, strict=True)) == list(expected)


CLASSES = [
    ("a:b:c", "other"), ("name:en1", "other"), ("x:County", "other"), (":foo", "lower_colon"),
    (":", "lower_colon"), ("", "lower"), ("a.b", "problemchars"), ("a b", "problemchars"),
    ("Upper", "other"), ("a1", "other"), ("amenity", "lower"), ("addr:street", "lower_colon"),
    ("a\n", "lower"), ("a\r", "problemchars"), ("a:b\n", "lower_colon"), ("a\n\n", "problemchars"),
]


def test_key_type(column):
    keys, expected = zip(*CLASSES, strict=True)
    assert column(clean.key_type, *keys) == list(expected)


def test_problem_chars(column):
    keys = [f"a{c}b" for c in "=+/&<>;'\"?%#$@,. \t\r\n"]
    assert column(clean.has_problem_chars, *keys) == [True] * len(keys)


def test_harmless_chars(column):
    assert column(clean.has_problem_chars, "a:b_c-d(e)é!*") == [False]


STREETS = [
    ("Old Mill St.", "St."), ("Harbour Rd.", "Rd."), ("Main Street", "Street"),
    ("Quay Ste.", "Ste."), ("Main St (rear)", "rear)"), ("Main ", None), ("No #", None),
    ("", None), ("Rue-Neuve", "Rue-Neuve"), ("Main St.\n", "St."), ("Way é-b", "b"),
]


def test_street_type(column):
    names, expected = zip(*STREETS, strict=True)
    assert column(clean.street_type, *names) == list(expected)


def test_unexpected_street_type(column):
    assert column(clean.unexpected_street_type, "Main Street", "Main St.", "Main ", "A Suite") == [
        None, "St.", None, None,
    ]


def test_update_name(column):
    mapping = {"St.": "Street", "Rd.": "Road"}
    fix = lambda c: clean.update_name(c, mapping)
    assert column(fix, "Old Mill St.", "Harbour Rd.", "St. Rd. St.", "None") == [
        "Old Mill Street", "Harbour Road", "Street Road Street", "None",
    ]


def test_update_name_replaces_substrings_longest_first_and_cascades(column):
    assert column(lambda c: clean.update_name(c, {"St": "Street"}), "Main Street") == ["Main Streetreet"]
    mapping = {"a": "x", "ab": "ca"}
    assert column(lambda c: clean.update_name(c, mapping), "ab a") == ["cx x"]
    assert column(lambda c: clean.clean_phone(c, {"(404) ": "404-"}), "(404) 1") == ["404-1"]


def test_predicates(column):
    assert column(clean.is_zipcode, "zip", "tiger:zip_left", "ZIP") == [True, True, False]
    assert column(clean.is_phone, "phone", "telephone", "Phone") == [True, True, False]
    assert column(clean.is_any_phone, "phone", "telePHONE", "fax") == [True, True, False]
    assert column(clean.is_street_name, "addr:street", "addr:street:name") == [True, False]
    starts = lambda c: clean.starts_with_any(c, ("6", "7", "4", "("))
    assert column(starts, "61", "71", "41", "(1", "1", "+4", "") == [True] * 4 + [False] * 3


def test_clean_tag_value_keeps_what_cannot_be_formatted(column):
    assert column(
        clean.clean_tag_value, ("phone", "(404) 555-1234"), ("contact:Phone", "7705551234"),
        ("phone", "1 404 555"), ("phone", "+1 404"), ("phone", "6"), ("fax", "404 555 1234"),
    ) == ["404-555-1234", "770-555-1234", "1 404 555", "+1 404", "6", "404 555 1234"]


def test_cleaning_stays_in_the_jvm(spark):
    from tests.plans import plan
    c = F.col("v")
    df = spark.createDataFrame([("a",)], "v STRING").select(
        clean.phone_format(c).alias("a"), clean.street_type(c).alias("b"), clean.key_type(c).alias("d"),
        clean.update_name(c, {"a": "b"}).alias("e"),
    )
    assert "Python" not in plan(df)
