import pytest

from tidyloom.rules import CleaningRules, default_document


def test_empty_document_switches_everything_off():
    rules = CleaningRules.parse("{}")
    assert rules == CleaningRules()
    assert rules.row_local and not rules.needs_order
    assert not rules.dedup.normalize_text


def test_keys_and_defaults():
    rules = CleaningRules.parse(
        {
            "format": {"phone": {"enabled": True, "columns": ["a", 3], "countryCode": "86"}},
            "columns": {"rename": {"mappings": [{"from": "a", "to": "b"}, {"from": 1}, "x"]}},
            "missing": {"fillDefault": {"values": {"a": "1", "b": 2}, "onlyWhenEmpty": False}},
        }
    )
    assert rules.format.phone.columns == ("a",)
    assert rules.format.phone.country_code == "86" and rules.format.phone.output == "digits"
    assert rules.columns.rename.mappings == ({"from": "a", "to": "b"}, {"from": "", "to": ""})
    assert rules.missing.fill_default.values == {"a": "1"}
    assert not rules.missing.fill_default.only_when_empty
    assert rules.missing.trim_whitespace_for_empty_check


def test_wrong_types_take_the_default():
    rules = CleaningRules.parse(
        {
            "format": {"currency": {"enabled": "yes", "decimalPlaces": -1, "symbol": None}},
            "missing": {"fillForwardBackward": {"limit": 2.5}},
            "dedup": [],
        }
    )
    assert rules.format.currency.enabled is False
    assert rules.format.currency.decimal_places == 2
    assert rules.format.currency.symbol == "¥"
    assert rules.missing.fill_forward_backward.limit is None


@pytest.mark.parametrize("bad", ["[]", "3", "{", '{"missing":{"fillForwardBackward":{"limit":-1}}}'])
def test_bad_documents_raise(bad):
    with pytest.raises(ValueError):
        CleaningRules.parse(bad)


def test_round_trip_and_template():
    template = default_document()
    assert template["dedup"]["normalizeText"] and template["format"]["text"]["trim"]
    rules = CleaningRules.parse(template)
    assert CleaningRules.parse(rules.to_document()) == rules
    assert set(template) == {"missing", "dedup", "format", "columns"}
    assert not rules.needs_order and rules.row_local
