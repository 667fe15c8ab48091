"""Card numbers among other digits, and dates of either order."""

from tallygrid.llm import pii
from tests.llm import brute


def card(digits, key="k"):
    return brute.pseudonymize(digits, key, pii.PATTERNS)[0]


def spaced(digits):
    return " ".join(digits[i : i + 4] for i in range(0, len(digits), 4))


def test_cards_and_dates_between_other_digits(spark):
    one, two = "4111111111111111", "5555555555554444"
    a, b = spaced(card(one)), spaced(card(two))
    date = lambda d: brute.pseudonymize(d, "k", pii.PATTERNS)[0]
    y, m, d = date("1990-12-31").split("-")
    said = [
        ("4111 1111 1111 1111 123", f"{a} 123", 1, 0),
        ("4111 1111 1111 1111 12/25", f"{a} 12/25", 1, 0),
        ("no 17 4111 1111 1111 1111.", f"no 17 {a}.", 1, 0),
        ("1234 5678 9012 4111 1111 1111 1111", f"1234 5678 9012 {a}", 1, 0),
        ("4111 1111 1111 1111 5555 5555 5555 4444", f"{a} {b}", 2, 0),
        ("4111 1111 1111 1111 1990-12-31", f"{a} {y}-{m}-{d}", 1, 1),
        ("4111 1111 1111 1112 123", "4111 1111 1111 1112 123", 0, 0),
        ("12/31/1990 and 1990-12-31", f"{m}/{d}/{y} and {y}-{m}-{d}", 0, 2),
        ("12.31.1990 and 31.12.1990", f"{m}.{d}.{y} and {d}.{m}.{y}", 0, 2),
        ("13/13/1990", "13/13/1990", 0, 0),
        ("1 2 3 " * 700 + one, None, None, None),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(said)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymize(rows, "k").collect()}
    for i, (t, want, cards, dates) in enumerate(said[:-1]):
        assert (got[i]["text"], got[i]["n_card"], got[i]["n_date"]) == (want, cards, dates), t
    assert len(got[len(said) - 1]["text"]) == len(said[-1][0])
