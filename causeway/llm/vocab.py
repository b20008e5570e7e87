"""Where the vocabulary files of public tokenizers lie."""

from __future__ import annotations


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
