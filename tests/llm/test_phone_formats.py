"""Telephone numbers of several countries, and one number in several formats."""

import re

import pytest
from helpers import SCHEMA

from brinework.llm.surrogates import replaced, pseudonymised

PHONES = ["+49 30 1234567", "+49 151 23456789", "+33 6 12 34 56 78", "06 12 34 56 78", "030/1234567", "+49 (0)30 1234567", "0049 30 1234567", "06.12.34.56.78", "+7 495 123-45-67", "+1 (743) 555-3824", "743-555-3824", "+34612345678", "0301234567", "(030) 1234567", "+44 20 7946 0958"]
PLAIN = ["on 01.02.2024 at noon", "on 05/11/2023 12:30", "0.12345678 of it", "12 of 345", "since 2019-2024", "01.02.24, 12:30", "page 100 200"]


@pytest.fixture(scope="module")
def told(spark):
    rows = [(i, f"call {p} 5 times, now", "", "") for i, p in enumerate(PHONES)] + [(100 + i, p, "", "") for i, p in enumerate(PLAIN)]
    rows += [(200, "card 4111 1111 1111 1111 or 4111111111111111 or 4111-1111-1111-1111", "", ""), (201, "ring +49 30 1234567, +4930 1234567 or +49/30/1234567", "", ""), (202, "iban DE44 5001 0517 5407 3249 31 or DE44500105175407324931", "", "")]
    return {r.doc_id: r for r in pseudonymised(spark.createDataFrame(rows, SCHEMA), "k").collect()}


def test_phones_of_several_countries(told):
    for i, p in enumerate(PHONES):
        shape = re.sub(r"\d", "D", p)
        got = re.fullmatch(r"call (.*) 5 times, now", told[i].text)[1]
        assert told[i].kinds == "phone" and got != p and re.sub(r"\d", "D", got) == shape, (p, told[i].text)
    assert told[0].text.startswith("call +49 ") and told[2].text.startswith("call +33 ") and told[3].text.startswith("call 0")
    assert [told[100 + i].text for i in range(len(PLAIN))] == PLAIN


def test_formats_of_one_number_share_a_surrogate(told):
    digits = lambda text: re.sub("[^0-9A-Z+]", "", text)
    for i, cut in ((200, " or "), (201, ", | or "), (202, " or ")):
        found = re.split(cut, told[i].text.split(" ", 1)[1])
        assert len(found) == told[i].n_entities > 1 and len({digits(x) for x in found}) == 1
    assert re.fullmatch(r"card \d{4} \d{4} \d{4} \d{4} or \d{16} or \d{4}-\d{4}-\d{4}-\d{4}", told[200].text)


def test_columns_of_any_name_keep_their_values(spark):
    text = "mail a.b@ex.org, account DE89 3704 0044 0532 0130 00"
    columns = ["_row", "_entities", "_new", "doc", "told", "name", "new", "kind", "value", "entities", "_d"]
    docs = spark.createDataFrame([(1, text, *[f"{c}-1" for c in columns]), (2, "plain", *[f"{c}-2" for c in columns]), (3, None, *[None] * len(columns))], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in columns))
    out = replaced(docs, "key", found="found")
    assert out.columns == [*docs.columns, "found"]
    rows = {r.doc_id: r for r in out.collect()}
    assert all(rows[i][c] == (f"{c}-{i}" if i < 3 else None) for i in rows for c in columns) and len(rows) == 3
    assert rows[2].text == "plain" and rows[3].text is None and rows[1].found == ["a.b@ex.org", "DE89 3704 0044 0532 0130 00"]
    iban = rows[1].text.split("account ")[1].replace(" ", "")
    moved = "".join(str(int(c, 36)) for c in iban[4:] + iban[:4])
    assert iban != "DE89370400440532013000" and iban[:2] == "DE" and int(moved) % 97 == 1
    assert replaced(docs, "key").columns.count("_entities") == 1
