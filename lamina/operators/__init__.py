"""Operators over keyed and versioned rows, as functions from DataFrame to DataFrame."""
