"""Registered queries: `registry`, and those of further operators in `further`."""

from . import registry, further  # noqa: F401, I001
