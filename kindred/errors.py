"""Errors of the commands, with their exit codes."""

from __future__ import annotations


class KindredError(Exception):
    exit_code = 2


class NoSourceFiles(KindredError):
    def __init__(self, path):
        super().__init__(f"No source files found in {path}")


class NoRecognizedFiles(KindredError):
    def __init__(self):
        super().__init__("No recognized source files found. Use --language to specify the language.")


class AmbiguousLanguage(KindredError):
    def __init__(self, languages):
        self.languages = sorted(languages)
        super().__init__(f"Multiple languages detected: {', '.join(self.languages)}. Use --language to specify which to analyze.")


class InvalidFingerprint(KindredError):
    def __init__(self, text):
        super().__init__(f"Invalid fingerprint: {text}")


class BadIgnoreFile(KindredError):
    """Raised instead of taking a malformed list for an empty one, which the next save would destroy."""


class CheckFailed(KindredError):
    exit_code = 1

    def __init__(self):
        super().__init__("Check failed")
