"""Errors raised by the library."""


class UtterlakeError(Exception):
    """Base of all errors of this library."""


class NoPrefixes(UtterlakeError):
    """A list of prefixes that must not be empty is empty."""


class DirtyInput(UtterlakeError):
    """An input directory is not in the state that an operator needs."""


class EmptyReference(UtterlakeError):
    """An error rate was asked for against an empty reference."""


class LabelMismatch(UtterlakeError):
    """The labels given and the labels found differ."""
