"""Journals and ordered events followed as streams."""
