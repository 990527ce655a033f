"""IBANs before other codes, IMEIs and national ids."""

import pytest

from statloom.llm import pii


def kinds(text):
    return [(k, text[a:b]) for k, a, b, _ in pii.find(text) if k not in ("card", "phone")]


@pytest.mark.parametrize("iban", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"])
@pytest.mark.parametrize("after", ["", " BIC COBADEFFXXX", " 2024-01-02", " EUR 500", " I said", ".", " 12", "\n"])
def test_ibans_end_where_their_country_says(iban, after):
    assert kinds(f"AB12 XY {iban}{after}") == [("iban", iban)]


def test_other_strings_are_not_ibans():
    for t in ("DE89370400440532013001", "DE893704004405320130001", "xDE89370400440532013000", "DE89 3704", "GB82", "DE89 3704 0044 0532 0130 00x"):
        assert kinds(t) == []
    assert kinds("DE89370400440532013000 GB82WEST12345698765432") == [("iban", "DE89370400440532013000"), ("iban", "GB82WEST12345698765432")]


def test_imeis_and_national_ids():
    assert kinds("device imei 490154203237518 lost") == [("imei", "490154203237518")]
    assert kinds("card 490154203237518 on this device") == []
    assert kinds("call 490154203237518") == []
    for t, n in (("social insurance", "130 692 544"), ("personnummer", "811218-9876"), ("identity", "8001015009087")):
        assert kinds(f"{t} {n} here") == [("national", n)]
        assert kinds(f"{t} {n[:-1]}{(int(n[-1]) + 1) % 10} here") == []
        assert kinds(f"part {n} here") == []
