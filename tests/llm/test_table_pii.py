"""Surrogates end, stay distinct, and cover possessives and mentions in lower case."""

import re
import string

import cases
import pytest

from seqmodel.llm import pii


def emails(text):
    return re.findall(r"\S+@\S+", text)


def test_short_addresses_of_one_domain_all_find_surrogates(spark):
    locals_ = [*string.ascii_lowercase, *(a + b for a in string.ascii_lowercase for b in string.ascii_lowercase)]
    texts = [" ".join(f"{x}@mail.com" for x in locals_[i : i + 30]) for i in range(0, len(locals_), 30)]
    rows = pii.with_surrogates(cases.documents(spark, texts), "secret").orderBy("doc_id").collect()
    new = [e for r in rows for e in emails(r.text)]
    assert len(new) == len(set(new)) == len(locals_)
    assert len({e.split("@")[1] for e in new}) == 1 and not set(new) & {f"{x}@mail.com" for x in locals_}


def test_different_domains_stay_different(spark):
    domains = [a + b + ".com" for a in string.ascii_lowercase for b in string.ascii_lowercase]
    texts = [" ".join(f"info@{d}" for d in domains[i : i + 50]) for i in range(0, len(domains), 50)] + ["me@aa.com info@ab.com"]
    rows = pii.with_surrogates(cases.documents(spark, texts), "secret").orderBy("doc_id").collect()
    new = [e.split("@")[1] for r in rows[:-1] for e in emails(r.text)]
    assert len(set(new)) == len(domains) == 676
    assert [e.split("@")[1] for e in emails(rows[-1].text)] == new[:2]


def test_full_plan_of_numbers_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "IDLE_ROUNDS", 3)
    monkeypatch.setattr(pii, "surrogate", lambda kind, canon, attempt, key: "same")
    with pytest.raises(ValueError, match="no free surrogates are left for entities of kind ip"):
        pii.with_surrogates(cases.documents(spark, ["10.0.0.1 10.0.0.2"]), "secret").collect()


def test_phone_keeps_its_country_code():
    for attempt in range(40):
        new = pii.surrogate("phone", "+442079460958", attempt, b"k" * 32)
        assert new.startswith("+44") and len(new) == len("+442079460958")


# Planted, not found: texts with the words that name one person.
PERSONS = [
    ("Mr James Smith came. Smith's dog barked at james smith.", ["Smith", "Smith", "smith"]),
    ("We met Mrs. Linda O'Neill; O’Neill is not O'Neill.", ["O'Neill", "O'Neill"]),
    ("Dr Brown spoke. BROWN left, and so did brown.", ["Brown", "BROWN", "brown"]),
]


def test_possessives_and_lower_case_mentions_are_the_same_person():
    for text, mentions in PERSONS:
        found = [e for e in pii.entities(text) if e.kind.startswith("family")]
        assert [text[e.start : e.end] for e in found] == mentions and len({e.canon for e in found}) == 1
        new, _ = pii.replaced(text, b"k" * 32, {})
        assert not any(re.search(rf"\b{re.escape(m)}\b", new) for m in mentions)
    text = PERSONS[0][0]
    given = [text[e.start : e.end] for e in pii.entities(text) if e.kind.startswith("given")]
    assert given == ["James", "james"]
    assert "'s dog barked" in pii.replaced(text, b"k" * 32, {})[0]
