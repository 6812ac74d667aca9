"""Token ids of the public byte-level BPE vocabulary."""

from __future__ import annotations

import os
import re

SPECIAL = "<|endoftext|>"
#: Runs of white space that the fast encoder's pattern could not take in one go.
LONG_RUN = re.compile(r"\s{10000}")


class Ids:
    """Text to the ids that ``tokenizers`` gives for the file, without added
    special tokens.

    The rank file beside it holds the same vocabulary; its encoder yields the
    same ids several times faster (a test compares them). Texts that hold the
    special token's string, which only the first library knows, or very long
    runs of white space, and files without a rank file go to ``tokenizers``
    itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(path)
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or SPECIAL in text or len(text) >= 10_000 and LONG_RUN.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
