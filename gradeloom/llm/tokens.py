"""Token ids of whole texts by a public byte-level vocabulary, inside Python workers.

The rank file holds the same vocabulary as the file for ``tokenizers`` and gives the same
ids (a test compares them) several times faster. As there, an added token of the vocabulary
has its own id wherever its string stands in a text. A document's end is marked by an id of
its own choice and its length is kept beside it, so such a string cannot forge an end.
"""

from __future__ import annotations

import base64
import json


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_encoders: dict = {}


def added_tokens() -> dict[str, int]:
    """Strings that the default vocabulary has an id of their own for."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def encoder(vocabulary: str | None = None, added: dict[str, int] | None = None):
    """One ``tiktoken.Encoding`` for each vocabulary file and worker; a file of one's own has the tokens ``added``."""
    path = vocabulary or default_vocabulary()
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        special = added if added is not None else {} if vocabulary else added_tokens()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def text_ids(text: str, vocabulary: str | None = None) -> list[int]:
    return encoder(vocabulary).encode(text, allowed_special="all")
