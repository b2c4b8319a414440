"""Closed-form operators as Column builders: they stay inside Catalyst and whole-stage code generation."""
