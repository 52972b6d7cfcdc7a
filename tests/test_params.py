import pytest

from storefront import params


def test_query_is_trimmed_and_not_blank():
    assert params.check_query("  gyms in Delhi  ") == "gyms in Delhi"
    for bad in ("", "  　", None, 3):
        with pytest.raises(ValueError):
            params.check_query(bad)


def test_placeholder_check_is_case_sensitive():
    assert params.check_template("gym in [city]") == "gym in [city]"
    with pytest.raises(ValueError):
        params.check_template("gym in [CITY]")


def test_limit_is_a_positive_integer():
    assert params.check_limit(1) == 1
    assert params.check_limit("20 rows") == 20
    assert params.check_limit(5000) == 5000
    for bad in (0, -3, "x", "", None):
        with pytest.raises(ValueError):
            params.check_limit(bad)


def test_fixed_values():
    assert len(params.LISTED_DOMAINS) == 35
    assert len(params.WHITESPACE) == 25
    assert [h for h, _ in params.EXPORT_COLUMNS] == [
        "Name", "Website", "Phone", "Email", "Address",
        "Facebook", "Instagram", "Twitter/X", "LinkedIn",
    ]
