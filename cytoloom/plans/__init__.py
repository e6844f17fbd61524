"""Declarations: signal policy, panel, rule hierarchy, configuration."""
