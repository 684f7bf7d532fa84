"""Whole plans: feature recipes, cross-validation, refit, named queries."""
