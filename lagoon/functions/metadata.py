"""Global attributes of tables, versions of what made them, and attributes of transformed axes."""

from __future__ import annotations

import importlib.metadata
import json
from datetime import UTC, datetime

import lagoon

# The attributes that the climate and forecast conventions name, with what stands for none.
GLOBAL = {"title": "", "institution": "n/a", "author": "n/a", "source": "n/a", "references": "n/a", "comment": "n/a"}
CONVENTIONS = "CF-1.9"
PACKAGES = ("numpy", "pandas", "pyarrow", "pyspark")


def list_versions(as_text: bool = True) -> str | dict[str, str]:
    """Versions of the packages that results depend on."""
    found = {p: importlib.metadata.version(p) for p in PACKAGES}
    return ", ".join(f"{p}-{v}" for p, v in found.items()) if as_text else found


def global_attrs(attributes: dict, conventions_only: bool = True) -> dict:
    """The conventional attributes of ``attributes``, those that lack filled in, with history and versions;
    the others too where not ``conventions_only``."""
    out = {k: attributes.get(k, default) for k, default in GLOBAL.items()}
    out |= {"history": f"Created @ {datetime.now(UTC):%Y-%m-%d %H:%M:%S}", "Conventions": CONVENTIONS, "lagoon_version": lagoon.__version__, "dependencies_version": list_versions()}
    return out if conventions_only else {k: v for k, v in attributes.items() if k not in GLOBAL} | out


def transformed_axis(axis: dict, name: str = "freq", units: str = "Hz") -> dict:
    """Axis (name, first, delta, n, attributes) of a series' full spectrum. It remembers the axis that it
    comes from: names, first coordinate and step."""
    n, step = axis["n"], 1 / (axis["n"] * axis["delta"])
    origin = {k: v for k, v in axis.items() if k != "n"}
    return {"name": name, "first": -(n // 2) * step, "delta": step, "n": n, "units": units, "origin": json.dumps(origin, sort_keys=True)}


def restored_axis(axis: dict) -> dict:
    """The axis that ``transformed_axis`` made this one of."""
    return json.loads(axis["origin"]) | {"n": axis["n"]}
