import hashlib
import math
import random
import re

import pytest

from cytoloom.llm import pii

SCHEMA = "doc_id long, text string, n_email string, n_pii int"


def test_permutation_is_a_bijection_and_inverts():
    f = pii.Feistel(b"k")
    for size in (1, 2, 7, 100, 257):
        image = [f.permute(x, size, b"t") for x in range(size)]
        assert sorted(image) == list(range(size))
        assert [f.invert(x, size, b"t") for x in image] == list(range(size))
    p, q = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", invert=True)
    for size in (2, 26, 300):
        image = [p.moved(x, size, "t") for x in range(size)]
        assert sorted(image) == list(range(size)) and all(x != y for x, y in enumerate(image))
        assert [q.moved(x, size, "t") for x in image] == list(range(size))


VALUES = [
    "hoccrcif.96@mail8.example.com", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "4111 1111 1111 1111", "4944339490429605", "5500-0000-0000-0004",
    "61.131.143.218", "192.168.1.20", "+1 (386) 555-3733", "212-555-0143", "+44 20 7946 0958", "123-45-6789", "2024-02-29", "31/12/1999", "1/13/2020", "7.3.2011", "March 9, 1987",
]


def test_values_change_within_their_format_and_come_back():
    p, q = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", invert=True)
    for value in VALUES:
        text = f"see {value}, and {value}."
        new, counts = p.apply(text)
        assert sum(counts.values()) == 2, value
        first, second = re.fullmatch(r"see (.*), and (.*)\.", new).groups()
        assert first == second != value
        if not re.match("March|[0-9.]+$", value):
            assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", first))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", value)))
        assert q.apply(new)[0] == text
        assert p.apply(first)[1] == p.apply(value)[1]  # still valid, of the same kind
    assert p.apply("4111 1111 1111 1111")[0].replace(" ", "") == p.apply("4111111111111111")[0]


def test_invalid_values_stay():
    p = pii.Pseudonyms()
    for text in ("4111 1111 1111 1112", "999.1.2.3", "1.2.3.4.5", "2023-02-29", "000-12-3456", "GB83 WEST 1234 5698 7654 32", "no digits", "page 12", "a@b", ""):
        assert p.apply(text) == (text, dict.fromkeys(pii.KINDS, 0))


def test_query_with_nulls_copies_and_clashing_names(spark):
    rng = random.Random(4)
    long = " ".join(rng.choices(["word", "4944339490429605", "61.131.143.218"], k=5000))
    rows = [(1, "mail eop.99@mail9.example.com", "x", 1), (1, "mail eop.99@mail9.example.com", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (None, long, "x", 1)]
    out = pii.pseudonymise(spark.createDataFrame(rows, SCHEMA), b"k")
    assert out.columns[:4] == ["doc_id", "text", "n_email", "n_pii"] and out.columns[4] == "_n_email"
    got = out.collect()
    p = pii.Pseudonyms(b"k")
    assert sorted((repr(r.doc_id), repr(r.text), r["_n_pii"]) for r in got) == sorted((repr(d), repr(t and p.apply(t)[0]), sum(p.apply(t or "")[1].values())) for d, t, *_ in rows)
    assert "4944339490429605" not in next(r.text for r in got if r.doc_id is None)
    assert pii.op8_pii(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ibans_before_other_tokens_change():
    """What follows an IBAN of full groups may look like one more."""
    p, q = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", invert=True)
    for value in ("ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "PL61 1090 1014 0000 0712 1981 2874", "GB82 WEST 1234 5698 7654 32", "ES9121000418450200051332"):
        for after in (" EUR", " 2024", " 2024 EUR", " AT61 1904 3002 3457 3201", " X", "."):
            text = f"pay {value}{after}"
            new, counts = p.apply(text)
            assert counts["iban"] == 1 + after.startswith(" AT") and value not in new, text
            assert q.apply(new)[0] == text


def test_more_forms_of_dates_change_and_come_back():
    p, q = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", invert=True)
    for value in ("12 March 2021", "Mar 5, 2021", "Mar. 5, 2021", "Sept 5, 2021", "2021/03/05", "2021/3/5", "05-03-2021", "03-25-2021", "5 Mar 2021", "05 March 2021", "March 5 2021", "March 3rd, 2021", "21st May 2021", "5. March 2021"):
        new, counts = p.apply(f"on {value}, and {value}.")
        assert counts["date"] == 2 and value not in new, value
        back, again = q.apply(new)
        assert again["date"] == 2 and (back == f"on {value}, and {value}." or value.startswith(("Sept", "05 March", "Mar")) or "May" in value), (value, new, back)
    for text in ("31 February 2021", "2021/13/05", "45-03-2021", "May 2021"):
        assert p.apply(text)[0] == text


def test_the_text_column_is_found_as_spark_finds_it(spark):
    [row] = pii.pseudonymise(spark.createDataFrame([(1, "call 212-555-0143")], "doc_id long, Text string"), b"k").collect()
    assert row.Text == pii.Pseudonyms(b"k").apply("call 212-555-0143")[0] != "call 212-555-0143"


def test_the_key_comes_from_the_session(spark):
    with pytest.warns(UserWarning, match="public default key"):
        assert pii.session_key(spark) == pii.DEFAULT_KEY
    spark.conf.set(pii.KEY_SETTING, "own")
    try:
        df = spark.createDataFrame([(1, "call 212-555-0143")], "doc_id long, text string")
        assert pii.op8_pii(df).first().text == pii.Pseudonyms(b"own").apply("call 212-555-0143")[0]
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def plain_feistel(key, x, size, tweak):
    """Eight rounds on the two digits of x to the base of the least whole number whose square reaches size, walked until
    the image is below size."""
    key = hashlib.sha256(key).digest()
    base = next(n for n in range(math.isqrt(size), math.isqrt(size) + 2) if n * n >= size)
    while True:
        a, b = x // base, x % base
        for k in range(8):
            mixed = int(hashlib.blake2b(f"{k}|{b}|{tweak}".encode(), key=key, digest_size=16).hexdigest(), 16)
            a, b = b, (a + mixed) % base
        x = a * base + b
        if x < size:
            return x


def luhn_ok(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_against_a_plain_construction():
    """Restricted kinds are one permutation, walked on into the kind's domain; of the others the checksums and formats."""
    p = pii.Pseudonyms(b"k")
    rng = random.Random(3)
    for _ in range(30):
        x = rng.randrange(1, 666) * 10**6 + rng.randrange(1, 100) * 10**4 + rng.randrange(1, 10**4)
        y = x
        while True:
            y = plain_feistel(b"k", y, 10**9, "ssn")
            if y // 10**6 not in (0, 666) and y // 10**6 < 900 and y // 10**4 % 100 and y % 10**4:
                break
        form = lambda v: f"{v // 10**6:03d}-{v // 10**4 % 100:02d}-{v % 10**4:04d}"
        assert p.apply(f"no {form(x)}.")[0] == f"no {form(y)}."
        payload = "4" + "".join(rng.choices("0123456789", k=14))
        card = next(payload + d for d in "0123456789" if luhn_ok(payload + d))
        new = p.apply(card)[0]
        assert new != card and len(new) == 16 and new[0] == "4" and luhn_ok(new)
        account = "".join(rng.choices("0123456789", k=18))
        iban = next(f"DE{k:02d}{account}" for k in range(2, 99) if int(account + "1314" + f"{k:02d}") % 97 == 1)
        new = p.apply(iban)[0]
        assert new != iban and new[:2] == "DE" and int(new[4:] + "1314" + new[2:4]) % 97 == 1
