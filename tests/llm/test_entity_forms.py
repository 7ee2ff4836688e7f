"""Forms of names and numbers that the surrogates find, and what they leave alone; the finder against a plain one."""

import random

import pytest
import regex
from helpers import SCHEMA

from brinework.llm import surrogates as S

#: A text with one entity, the pattern of what comes out, and the kind.
FOUND = [
    ("saw Mr O'Brien go", r"saw Mr O'\p{Lu}\p{Ll}+ go", "name"),
    ("saw Mrs van der Berg go", r"saw Mrs van der \p{Lu}\p{Ll}+ go", "name"),
    ("saw Mr Jean-Pierre Dupont go", r"saw Mr \p{Lu}\p{Ll}+-\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+ go", "name"),
    ("saw JOHN SMITH go", r"saw \p{Lu}{3,} \p{Lu}{3,} go", "name"),
    ("saw MR TANAKA go", r"saw MR \p{Lu}{3,} go", "name"),
    ("saw Dr. J. Smith go", r"saw Dr\. J\. \p{Lu}\p{Ll}+ go", "name"),
    ("saw Mr McDonald go", r"saw Mr \p{Lu}\p{Ll}+ go", "name"),
    ("saw Mr Al go", r"saw Mr \p{Lu}\p{Ll}+ go", "name"),
    ("saw Anna de la Cruz go", r"saw \p{Lu}\p{Ll}+ de la \p{Lu}\p{Ll}+ go", "name"),
    ("saw Frau Müller-Lüdenscheidt go", r"saw Frau \p{Lu}\p{Ll}+-\p{Lu}\p{Ll}+ go", "name"),
    ("My name is Yuki Tanaka, hello", r"My name is \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+, hello", "name"),
    ("Меня зовут Юрий Гагарин.", r"Меня зовут \p{IsCyrillic}+ \p{IsCyrillic}+\.", "name"),
    ("SSN: 123 45 6789.", r"SSN: \d{3} \d\d \d{4}\.", "ssn"),
    ("call me at 555-1234 now", r"call me at \d{3}-\d{4} now", "phone"),
    ("from 2001:db8::1 on", r"from 2001:[0-9a-f]{3,4}::[0-9a-f]{4} on", "ip6"),
    ("from fe80:0:0:0:1ff:fe23:4567:890a on", r"from fe80(?::[0-9a-f]{4}){7} on", "ip6"),
]
PLAIN = ["page 123 45 6789", "lines 555-1234", "at 12:30:45 or 1:2:3", "std::vector and abc::def", "DAVID AND GOLIATH", "O'Brien alone", "van der Berg", "JOHN", "Mr and Mrs", "", "call 55-1234", "name is Bond"]


@pytest.fixture(scope="module")
def told(spark):
    rows = [(i, t, "", "") for i, (t, _, _) in enumerate(FOUND)] + [(100 + i, t, "", "") for i, t in enumerate(PLAIN)]
    rows += [(200, "Mr John Smith, JOHN SMITH, Mr. Smith and Jean Smith-Dupont", "", ""), (201, "2001:db8::1 or 2001:DB8::1", "", "")]
    return {r.doc_id: r for r in S.pseudonymised(spark.createDataFrame(rows, SCHEMA), "k").collect()}


@pytest.mark.parametrize("i", range(len(FOUND)))
def test_forms_are_replaced_in_their_format(told, i):
    text, shape, kind = FOUND[i]
    assert told[i].kinds == kind and told[i].n_entities == 1 and told[i].text != text and regex.fullmatch(shape, told[i].text), told[i].text


def test_what_is_no_entity_stays(told):
    assert [told[100 + i].text for i in range(len(PLAIN))] == PLAIN and not any(told[100 + i].n_entities for i in range(len(PLAIN)))


def test_one_person_in_several_forms(told):
    got = regex.fullmatch(r"Mr (\w+) (\w+), (\w+) (\w+), Mr\. (\w+) and (\w+) (\w+)-(\w+)", told[200].text)
    assert got, told[200].text
    assert got[1].upper() == got[3] and got[2].upper() == got[4] and got[5] == got[2] == got[7] and "Smith" not in told[200].text
    a, b = told[201].text.split(" or ")
    assert a == b != "2001:db8::1"


def plain_entities(text: str) -> list[tuple[int, int]]:
    """Place by place: the first kind whose own pattern fits there, then on behind it."""
    # Spark's patterns know \w only as ASCII
    ascii_words = lambda p: regex.compile(p.replace(r"(?!\w)", "(?![A-Za-z0-9_])").replace(r"\w", "A-Za-z0-9_"))
    kinds = [ascii_words(p) for p in S.KINDS.values()] + [ascii_words(p) for _, p in S.ANNOUNCED.values()]
    words = [None] * len(S.KINDS) + [regex.compile(f"(?:{w})$") for w, _ in S.ANNOUNCED.values()]
    out, at = [], 0
    while at < len(text):
        if at and (text[at - 1].isalpha() or text[at - 1].isdecimal()):
            at += 1
            continue
        for kind, word in zip(kinds, words):
            found = kind.match(text, at) if word is None or word.search(text[max(0, at - 60) : at]) else None
            if found:
                out.append(found.span())
                at = found.end()
                break
        else:
            at += 1
    return out


def test_finder_against_a_plain_one(spark):
    draw = random.Random(3)
    bits = [t for t, _, _ in FOUND] + PLAIN + ["a.b@ex.org", "10.0.0.1", "4111 1111 1111 1111", "password = hunter2secret", "+49 30 1234567", "DE89 3704 0044 0532 0130 00", "Mr", "Anna", "SMITH", ", ", ": ", "-", "'"]
    rows = [(i, draw.choice([" ", ", ", "\n", ""]).join(draw.choices(bits, k=draw.randint(1, 12))), "", "") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: list(r.e) for r in docs.select("doc_id", S.entities(docs["text"]).alias("e")).collect()}
    spans = {i: plain_entities(t) for i, t, _, _ in rows}
    assert got == {i: [t[a:b] for a, b in spans[i]] for i, t, _, _ in rows}
    # every text keeps what is no entity, and none keeps an entity it had as a whole
    for r in S.replaced(docs, "k").collect():
        text, ends = rows[r.doc_id][1], [0, *[x for span in spans[r.doc_id] for x in span], None]
        between = [regex.escape(text[a:b]) for a, b in zip(ends[::2], ends[1::2])]
        assert regex.fullmatch(".+?".join(between), r.text, regex.DOTALL), (text, r.text)
