"""What can go wrong."""


class TokenizerError(ValueError):
    """A pattern that doesn't compile, ids that aren't UTF-8, an unknown name, a bad special token."""


class VocabError(OSError):
    """A vocabulary that can't be read: no file, no separator, bad base64, a bad rank."""
