"""Errors of the vocabulary review."""


class ReviewError(Exception):
    """Base of all errors raised on purpose."""


class MalformedLexiconError(ReviewError):
    """The lexicon cannot be parsed, or an entry is not a list."""


class DuplicateBaseWordError(ReviewError):
    """A base word has two entries."""


class DuplicateAlternativeError(ReviewError):
    """An alternative is listed twice."""


class BaseInAlternativesError(ReviewError):
    """A word is a base and an alternative."""


class SelfReferentialAlternativeError(ReviewError):
    """An entry lists its own base."""


class EmptyAlternativesError(ReviewError):
    """An entry has no alternatives."""
