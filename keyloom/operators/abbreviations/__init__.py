"""Abbreviation dictionaries: candidates, contexts, savings, selection and evaluation."""
