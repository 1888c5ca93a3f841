"""Readers of models, sheets, registers and earlier output, each with an explicit schema and its problems as rows."""
