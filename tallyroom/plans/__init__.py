"""Queries of the operators over the tables of a folder, each with independent SQL where SQL can say it."""
