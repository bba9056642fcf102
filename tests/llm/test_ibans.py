"""Ends of account numbers."""

import pytest

from codeloom.llm import pii

IBAN = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "FR1420041010050500013M02606"]


@pytest.mark.parametrize("iban", IBAN)
@pytest.mark.parametrize("tail", [" Please pay", " BIC COBADEFF", " 2024 INVOICE 77", ".", "", "please", "\nTO"])
@pytest.mark.parametrize("lead", [": ", " of the account that you will find below, is ", " AB12, then "])
def test_iban_ends_where_its_country_says(iban, tail, lead):
    text = "IBAN" + lead + iban + tail
    assert [text[s:e] for k, s, e in pii.ordered(text, pii.automaton()) if k == "account"] == [iban]
    assert iban not in pii.redact_text(text, pii.automaton())


def test_a_false_check_number_is_no_iban():
    assert not pii.ordered("IBAN DE88 3704 0044 0532 0130 00 Please", pii.automaton()) or all(k != "account" for k, _, _ in pii.ordered("IBAN DE88 3704 0044 0532 0130 00 Please", pii.automaton()))
