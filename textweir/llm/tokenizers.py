"""Public tokenizers: where their files are, and one loaded copy a Python worker."""

from __future__ import annotations

import os
from functools import lru_cache

DEFAULT = "byte_bpe_50k.json"


def tokenizer_path(name: str = DEFAULT, folder: str | None = None) -> str:
    """The file of a public tokenizer; ``folder`` overrides where the files lie."""
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


@lru_cache(4)
def load(path: str):
    """The tokenizer of a ``tokenizers`` file. Texts that look like its special tokens are ordinary text."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made
