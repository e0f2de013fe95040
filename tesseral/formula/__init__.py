"""The scenario language: events as formulas over allele frequencies of samples."""
