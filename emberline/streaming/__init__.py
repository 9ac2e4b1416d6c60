"""Micro-batch forms of the operators, with state kept in versioned tables."""
