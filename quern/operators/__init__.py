"""Operators on whole tables: repair, profile, rules, recipes, target analysis, contracts, charts and diffs."""
