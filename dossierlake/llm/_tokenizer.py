"""Loading a public tokenizer file in the driver or a Python worker, once a process."""

from __future__ import annotations

import os
from functools import lru_cache


def tokenizer_path(name: str) -> str:
    """A path is taken as it is; a bare file name is looked up among the installed public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def special_strings(tokenizer) -> list[str]:
    """Strings that the library takes out of a text before anything else."""
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]
