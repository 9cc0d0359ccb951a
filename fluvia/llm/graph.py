"""Connected components of similarity links: those of the library, whose rounds are tables in the shared folder."""

from fluvia.functions.graph import components

__all__ = ["components"]
