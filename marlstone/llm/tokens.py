"""Byte-level BPE ids at the speed that whole corpora need.

``ByteBpe`` gives the ids of the tokenizers library for one of its byte-level
BPE files. Such a vocabulary lists merges in rank order, so tiktoken can run it
as ranks (checked when a file is loaded), at about twice the speed. A text is
cut at the file's added tokens, which have ids of their own; kinds of added
tokens that tiktoken can't match alike are refused when a file is loaded.
"""

from __future__ import annotations

import json

import numpy as np

_LOADED: dict[str, ByteBpe] = {}


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        added = spec.get("added_tokens", [])
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in added):
            raise ValueError(f"{path}: added tokens that take in or need what stands beside them")
        special = {x["content"]: x["id"] for x in added}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
        ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab["".join(m)] for m in merges]
        if made != sorted(made):
            raise ValueError(f"{path}: ids don't follow the order of merges")
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.wide = "<u2" if self.size <= 1 << 16 else "<u4"
        self._encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self._bytes = [b""] * self.size
        for k, v in ranks.items():
            self._bytes[v] = k
        for k, v in special.items():
            self._bytes[v] = k.encode()

    def packed(self, text: str) -> bytes:
        """Ids as little-endian numbers of type ``wide``."""
        return self._encoding.encode_to_numpy(text, allowed_special="all").astype(self.wide).tobytes()

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.wide)

    def text(self, ids: np.ndarray) -> str:
        table = self._bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str | None = None) -> ByteBpe:
    """The tokenizer at ``path`` (the public 50k byte-level one if None), once per process."""
    path = path or default_path()
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]
