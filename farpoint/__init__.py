"""Distance-based outlier detection, sensor preparation and box joins as Spark plans."""

from farpoint.specs import Attr, OutlierParams, WindowSpec, attr_roles, parse_settings

__all__ = ["Attr", "OutlierParams", "WindowSpec", "attr_roles", "parse_settings"]
