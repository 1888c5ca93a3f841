"""Stages of a compile run as DataFrame plans."""
