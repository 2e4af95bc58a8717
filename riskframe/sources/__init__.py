"""Readers and writers for the applicant tables."""
