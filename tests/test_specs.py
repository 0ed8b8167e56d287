import pytest

from farpoint import Attr, OutlierParams, WindowSpec, attr_roles, parse_settings
from farpoint.specs import identity_columns, used_attrs

SENSOR = {
    "outlier.typ": "ThreshOutlier", "outlier.R": 5, "outlier.k": 6, "win.width": 12.0, "win.slideLen": 3,
    "dataattr.label": "None",
    "dataattr.type": "(year,nominal,Int) (day,nominal,Int) (EDA,numeric,Double) (avg(Event),numeric,Double)",
    "dataattr.notUsed": "year,day",
    "dataattr.used": "EDA",
}


def test_settings_become_typed_values():
    window, params, attrs = parse_settings(SENSOR)
    assert (window, params) == (WindowSpec(12, 3), OutlierParams(5.0, 6))
    assert [a.name for a in used_attrs(attrs)] == ["EDA"]
    # An attribute that is in no list at all counts as not used.
    assert identity_columns(attrs) == ["year", "day", "avg(Event)"]


def test_blank_used_list_takes_all_but_label_and_not_used():
    settings = SENSOR | {
        "dataattr.type": "(ID,nominal,Int) (Slope,numeric,Double) (Soil1,nominal,Int) (Cover,nominal,Int)",
        "dataattr.notUsed": "ID,Cover", "dataattr.used": " ", "dataattr.label": "Cover",
    }
    roles = {a.name: a.role for a in parse_settings(settings)[2]}
    assert roles == {"ID": "unUsed", "Slope": "used", "Soil1": "used", "Cover": "unUsed"}


def test_label_that_is_not_excluded_is_label():
    roles = attr_roles([("x", "numeric", "Double"), ("y", "nominal", "Int")], label="y")
    assert [a.role for a in roles] == ["used", "label"]


def test_windows_and_thresholds_are_checked():
    assert WindowSpec(10, 3).panes == 3 and WindowSpec(10, 3).points == 9
    for bad in ((2, 3), (3, 0)):
        with pytest.raises(ValueError):
            WindowSpec(*bad)
    with pytest.raises(ValueError):
        OutlierParams(-1.0, 1)
    assert Attr("x").numeric and not Attr("y", "nominal").numeric
