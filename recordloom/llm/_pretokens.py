"""Cuts texts into chunks whose byte-pair encodings simply follow one another, and gives the ids of whole texts."""

import functools
import json
import os
import re
from collections.abc import Callable

import numpy as np

#: A single space between two non-space characters always starts a new pre-token.
_EDGE = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s |  | \s")


def chunks(text: str) -> list[str]:
    """Parts of text; each but the first follows a single space, which is taken off."""
    if _ODD.search(text) or text[:1] == " " or text[-1:] == " ":
        return _EDGE.split(text)
    return text.split(" ")


class Memo:
    """Values of chunks, computed in batches for those not seen before; beyond `most` it starts anew."""

    def __init__(self, compute: Callable[[list[str]], list], most: int = 400_000) -> None:
        self.compute, self.most = compute, most
        self.first: dict[str, object] = {}
        self.later: dict[str, object] = {}

    def rows(self, texts: list[str]) -> list[list]:
        """For each text, the values of its chunks in order."""
        if len(self.first) + len(self.later) > self.most:
            self.first.clear()
            self.later.clear()
        cut = [chunks(t) for t in texts]
        for known, lead, new in (
            (self.first, "", list({c[0] for c in cut} - self.first.keys())),
            (self.later, " ", list(set().union(*(c[1:] for c in cut)) - self.later.keys())),
        ):
            known.update(zip(new, self.compute([lead + x for x in new]), strict=True))
        get = self.later.__getitem__
        return [[self.first[c[0]], *map(get, c[1:])] for c in cut]


@functools.cache
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text under a tokenizer file, without added special tokens; nothing is kept from text to text.

    A byte-level BPE whose ids rise with its merges is run by tiktoken, which gives the same ids in a third of
    the time; any other file by the tokenizers library itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = _ranks(spec)
    if ranks:
        import tiktoken

        from .token_counts import PATTERN

        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: own.encode_to_numpy(text, allowed_special="all")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    return lambda text: np.array(lib.encode(text, add_special_tokens=False).ids, np.uint32)


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of each token -> id, where the file is a plain byte-level BPE whose ids rise with its merges; else None."""
    from .token_counts import byte_letters

    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    if not plain or any(odd) or spec["normalizer"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        return None
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    letters = {c: b for b, c in enumerate(byte_letters())}
    added = {t["content"] for t in spec["added_tokens"]}
    own = {t: i for t, i in model["vocab"].items() if t not in added}
    if any(a >= b for a, b in zip(merged, merged[1:])) or len(own) != len(merged) + 256 or not all(c in letters for t in own for c in t):
        return None
    return {bytes(map(letters.__getitem__, t)): i for t, i in own.items()}
