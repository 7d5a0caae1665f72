"""Whole workflows: splits, fitting, evaluation, publishing."""
