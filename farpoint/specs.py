"""Job settings as typed values: windows, outlier thresholds and attribute roles."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class WindowSpec:
    """Count-based sliding window: ``width`` points, moving by ``slide`` points."""

    width: int
    slide: int

    def __post_init__(self) -> None:
        if self.slide < 1 or self.width < self.slide:
            raise ValueError(f"need 1 <= slide <= width, got width={self.width} slide={self.slide}")

    @property
    def panes(self) -> int:
        """Slides per window."""
        return int(self.width // self.slide)

    @property
    def points(self) -> int:
        """Points per full window (the width rounded down to whole slides)."""
        return self.panes * self.slide


@dataclass(frozen=True)
class OutlierParams:
    """A point with fewer than ``k`` others within ``radius`` is an outlier."""

    radius: float
    k: int

    def __post_init__(self) -> None:
        if self.radius < 0 or self.k < 1:
            raise ValueError(f"need radius >= 0 and k >= 1, got {self}")


@dataclass(frozen=True)
class Attr:
    """One input column: ``kind`` is numeric or nominal, ``role`` used, unUsed or label."""

    name: str
    kind: str = "numeric"
    dtype: str = "Double"
    role: str = "used"

    @property
    def numeric(self) -> bool:
        return self.kind == "numeric"


def attr_roles(
    types: list[tuple[str, str, str]],
    used: list[str] | None = None,
    not_used: list[str] | None = None,
    label: str | None = None,
) -> list[Attr]:
    """Resolve the role of each attribute.

    Without a ``used`` list every attribute counts as used except those in ``not_used`` and the
    label. An attribute that is both not used and the label is ``unUsed``.
    """
    skipped = set(not_used or [])
    chosen = set(used) if used else {n for n, _, _ in types if n not in skipped and n != label}

    def role(name: str) -> str:
        if name in chosen:
            return "used"
        return "label" if name == label and name not in skipped else "unUsed"

    return [Attr(name, kind, dtype, role(name)) for name, kind, dtype in types]


def used_attrs(attrs: list[Attr]) -> list[Attr]:
    """Attributes that enter the distance."""
    return [a for a in attrs if a.role == "used"]


def identity_columns(attrs: list[Attr]) -> list[str]:
    """Columns that name a point in reports: all those marked ``unUsed``."""
    return [a.name for a in attrs if a.role == "unUsed"]


def parse_settings(settings: dict[str, object]) -> tuple[WindowSpec, OutlierParams, list[Attr]]:
    """Typed settings from a flat mapping with the keys of a detection job.

    ``dataattr.type`` holds space-separated ``(name,kind,dtype)`` triples; ``dataattr.used`` and
    ``dataattr.notUsed`` are comma lists, where a blank ``used`` stands for the default rule.
    """
    triples = []
    for item in str(settings["dataattr.type"]).split():
        name, kind, dtype = item[1:-1].split(",")
        triples.append((name, kind, dtype))
    used = str(settings.get("dataattr.used", " "))
    attrs = attr_roles(
        triples,
        used=None if not used.strip() else used.split(","),
        not_used=str(settings.get("dataattr.notUsed", "")).split(","),
        label=str(settings.get("dataattr.label", "")) or None,
    )
    window = WindowSpec(int(float(str(settings["win.width"]))), int(str(settings["win.slideLen"])))
    return window, OutlierParams(float(str(settings["outlier.R"])), int(str(settings["outlier.k"]))), attrs
