"""Operations of a training-data pipeline, as DataFrame -> DataFrame functions.

Nothing else in the library imports this subpackage.  ``queries`` holds the
queries and their SQL; each operator has a module of its own.
"""
