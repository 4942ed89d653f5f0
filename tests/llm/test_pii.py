import re

from pyspark.sql import functions as F

from mapengine.llm import pii


def replaced(spark, *texts, key="k"):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n_private) for r in pii.pseudonymised(rows, key).orderBy("doc_id").collect()]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_equal_values_stay_linked_whatever_their_spelling(spark):
    (text, n), (again, _) = replaced(
        spark, "card 4111111111111111 or 4111-1111-1111-1111, +1 (404) 555-1234, 404-555-1234", "x 4111 1111 1111 1111 y")
    assert n == 4
    cards = [re.sub(r"\D", "", c) for c in re.findall(r"\b\d[\d -]{14,18}\d\b", text + " " + again)][:2]
    assert cards[0] == cards[1] == re.sub(r"\D", "", again)
    assert cards[0] != "4111111111111111" and luhn(cards[0])
    phones = re.findall(r"\(?(\d{3})\)?[ -](\d{3})-(\d{4})", text)
    assert phones[-1] == phones[-2] and phones[-1] != ("404", "555", "1234")


def test_formats_are_kept(spark):
    text = ("mail Ann.B-42@mail.example.com ip 10.0.255.1 born 1984-02-29, 02/29/1984 and 29.02.1984 "
            "ssn 123-45-6789 call (404) 555-1234 or +44 20 7946 0958.")
    (new, n), = replaced(spark, text)
    assert n == 8
    form = r"[A-Z][a-z]{2}\.[A-Z]-\d\d@mail\.example\.com"
    assert re.match(rf"mail {form} ip (\d+\.){{3}}\d+ born \d{{4}}-\d\d-\d\d, \d\d/\d\d/\d{{4}} and \d\d\.\d\d\.\d{{4}} "
                    r"ssn \d{3}-\d\d-\d{4} call \(\d{3}\) \d{3}-\d{4} or \+44 \d\d \d{4} \d{4}\.$", new)
    y, m, d = re.search(r"born (\d+)-(\d+)-(\d+)", new).groups()
    assert f"{m}/{d}/{y}" in new and f"{d}.{m}.{y}" in new
    for old in ("Ann.B", "10.0.255.1", "1984", "123-45-6789", "555-1234", "7946 0958"):
        assert old not in new


def test_what_is_not_valid_stays(spark):
    texts = ["4111111111111112", "999.1.2.3", "1985-02-29", "000-12-3456", "version 2.0 of 12", "a@b", None, "", "é" * 9]
    assert replaced(spark, *texts) == [(t, 0) for t in texts]


def test_permutations_are_one_to_one(spark):
    ids = spark.range(35 * 24)
    found = {r[0] for r in ids.select(pii.feistel(F.col("id"), 35, 24, "k")).collect()}
    assert found == set(range(35 * 24))
    other = [r[0] for r in ids.orderBy("id").select(pii.feistel(F.col("id"), 35, 24, "other")).collect()]
    assert sorted(other) == list(range(35 * 24)) and other != list(range(35 * 24))
    words = spark.createDataFrame([(a + b,) for a in "abcdefghijklmnopqrstuvwxyz" for b in "0123456789"], "w string")
    texts = {r[0] for r in words.select(pii.feistel_text(F.col("w"), "k")).collect()}
    assert len(texts) == 260 and all(re.fullmatch("[a-z][0-9]", t) for t in texts)


def test_mail_in_long_runs_takes_linear_time(spark):
    long = "a" * 200_000
    assert replaced(spark, long + " 1", long + "@x 1") == [(long + " 1", 0), (long + "@x 1", 0)]


def test_awkward_rows(documents, awkward):
    docs = documents(*awkward)
    out = pii.pseudonymised(docs, "k")
    assert out.columns == [*docs.columns, "n_private", "private"]
    key = lambda r: (repr(r.doc_id), repr(r.text))
    assert [r.text for r in sorted(out.collect(), key=key)] == [r.text for r in sorted(docs.collect(), key=key)]
    assert pii.pseudonymised(docs.where("doc_id < 0"), "k").count() == 0
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


def test_values_beside_or_inside_a_failed_card(spark):
    cases = {
        "212-555-1234 646-555-9876": (2, r"\d{3}-\d{3}-\d{4} \d{3}-\d{3}-\d{4}", ("212-555-1234", "646-555-9876")),
        "4111 1111 1111 1111 123": (1, r"4\d{3} \d{4} \d{4} \d{4} 123", ("4111 1111 1111 1111",)),
        "4111-1111-1111-1111 12/26": (1, r"4\d{3}-\d{4}-\d{4}-\d{4} 12/26", ("4111-1111-1111-1111",)),
        "Order 12345 2024-01-05": (1, r"Order 12345 \d{4}-\d\d-\d\d", ("2024-01-05",)),
        "apt 101 415-555-1234": (1, r"apt 101 \d{3}-\d{3}-\d{4}", ("415-555-1234",)),
        "id 9876 123-45-6789": (1, r"id 9876 \d{3}-\d\d-\d{4}", ("123-45-6789",)),
        "12 34 4111 1111 1111 1111": (1, r"12 34 4\d{3} \d{4} \d{4} \d{4}", ("4111 1111 1111 1111",)),
        "4111111111111111 123": (1, r"4\d{15} 123", ("4111111111111111",)),
        "4111 1111 1111 1111 212-555-1234": (2, r"4\d{3} \d{4} \d{4} \d{4} \d{3}-\d{3}-\d{4}", ("1111 1111", "212-555-1234")),
        "3056 930902 5904 x": (1, r"3\d{3} \d{6} \d{4} x", ("930902",)),
    }
    for (new, n), (text, (want, form, gone)) in zip(replaced(spark, *cases), cases.items(), strict=True):
        assert n == want, text
        assert re.fullmatch(form, new), (text, new)
        assert not any(old in new for old in gone), (text, new)


def test_phones_of_any_range_and_dates_with_the_day_first(spark):
    texts = ["+1 (017) 555-7713", "+1 (132) 555-1352", "(404) 155-1234", "25/12/2024", "25.12.2024"]
    forms = [r"\+1 \(\d{3}\) \d{3}-\d{4}"] * 2 + [r"\(\d{3}\) \d{3}-\d{4}", r"\d\d/\d\d/\d{4}", r"\d\d\.\d\d\.\d{4}"]
    found = replaced(spark, *texts)
    for old, form, (new, n) in zip(texts, forms, found, strict=True):
        assert n == 1 and new != old and re.fullmatch(form, new), (old, new)
    assert found[3][0].replace("/", ".") == found[4][0]
    for new, _ in found[:3]:  # numbers outside the ranges in use stay outside
        d = re.sub(r"\D", "", new)[-10:]
        assert d[0] in "01" or d[3] in "01"
