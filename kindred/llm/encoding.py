"""Token ids of whole texts, through a file of a public tokenizer."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Sequence

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Fixed value: the published split pattern of byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters on whose classes two regex libraries might differ: texts with one are encoded by the library itself.
_ODD = re.compile("[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ–—‘-”]")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts as ``tokenizers`` does, without special tokens being added.

    If a byte-level file's merges are in the order of their ids, its ids follow from the ranks of its vocabulary
    alone, and a faster library computes them from the same file.  Texts that spell an added token, texts with
    unusual characters and tokenizers of other kinds go through ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.id_type = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.ranked = self._ranked(spec)

    def _ranked(self, spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        if not byte_level or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"].get("".join(p)) != 256 + i for i, p in enumerate(pairs)):
            return None
        import tiktoken

        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added}
        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        out = []
        for text in texts:
            if self.ranked is None or any(t in text for t in self.added) or _ODD.search(text):
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                ids = self.ranked.encode_to_numpy(text)
            out.append(ids.astype(self.id_type).tobytes())
        return out


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
