"""Surrogates where the values leave little to draw from."""

from __future__ import annotations

import re

import pytest

from pageloom.llm import surrogates


def test_every_value_gets_a_surrogate(spark):
    texts = ["password=*** token=… api_key=пароль secret=鍵 passwd=!?", "call १२३-४५६-७८९० or ١٢٣-٤٥-٦٧٨٩ or +१२३ ४५६ ७८९०",
             "card ४१११ ११११ ११११ ११११, mail -@-.com, ip १.२.३.४", " ".join(f"token={i}" for i in range(10))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.pseudonymize(docs).collect()}
    assert [got[i].n_entities for i in range(4)] == [5, 3, 3, 10]
    secrets = [re.findall(r"=(\S+)", t) for t in (texts[0], got[0].text)]
    assert all(a not in b for a, b in zip(*secrets)) and len(set(secrets[1])) == 5
    assert re.fullmatch(r"call [०-९]{3}-[०-९]{3}-[०-९]{4} or [٠-٩]{3}-[٠-٩]{2}-[٠-٩]{4} or \+१[०-९]{2} [०-९]{3} [०-९]{4}", got[1].text)
    assert not {"१२३-४५६-७८९०", "١٢٣-٤٥-٦٧٨٩"} & set(got[1].text.split())
    card, mail = re.search(r"card ([०-९ ]+), mail (\S+),", got[2].text).groups()
    assert surrogates.luhn(card.replace(" ", "")) == 0 and card != "४१११ ११११ ११११ ११११" and mail != "-@-.com"
    tokens = re.findall(r"token=(\S+)", got[3].text)
    assert len(set(tokens)) == 10 and not set(tokens) & set("0123456789")


@pytest.mark.parametrize("kind, value, found", [
    ("email", "a@b.com", None), ("ip", "10.0.0.1", None), ("secret", "7", None), ("ssn", "123456789", "123-45-6789"),
    ("phone", "+4912345678", "+49 (123) 456-78"), ("phone", "1234567890", "(123) 456-7890"), ("iban", "DE00123456789", "DE00 1234 5678 9"),
    ("card", "4111111111111111", "4111 1111 1111 1111"), ("name-f", "anna", None)])
def test_spaces_grow(kind, value, found):
    last = [surrogates.surrogate("k", kind, value, a) for a in (0, 60)]
    assert len(last[1]) > len(last[0]) + 20
    if found:  # nothing of a longer replacement is lost in the format
        assert re.sub(r"\W", "", surrogates.pour(found, last[1])) == last[1].replace("+", "")


def test_later_bare_names(spark):
    text = "Keller? Mrs. Anna Keller came.\nKeller said: Anna, kellers and Kellerman; KELLER, keller.\nMail x@y.com Keller"
    row = surrogates.pseudonymize(spark.createDataFrame([(1, text), (2, "Keller alone, 7")], "doc_id long, text string")).where("doc_id = 1").first()
    given, family = re.search(r"Mrs\. (\w+) (\w+) came", row.text).groups()
    assert row.text.startswith("Keller? ") and re.search(rf"\n{family} said: {given}, kellers and Kellerman; KELLER, keller\.\nMail \S+ {family}$", row.text)
    assert row.n_entities == 5
