"""The byte-level vocabulary, loaded once per Python worker."""

from __future__ import annotations

import base64
import functools
import json

import numpy as np


@functools.cache
def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.cache
def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def default_json() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def encoding(path: str, special: tuple[str, int] | None = None):
    """A tiktoken encoding over a rank file, with one special token or none."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks(path), special_tokens=dict([special] if special else []))


@functools.cache
def token_bytes(path: str) -> np.ndarray:
    """Bytes of each token."""
    table = ranks(path)
    out = np.zeros(max(table.values()) + 1, np.int64)
    for k, v in table.items():
        out[v] = len(k)
    return out


def _byte_letters() -> dict[str, int]:
    """The printable stand-in letter of each byte in a tokenizers file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def specification(json_path: str) -> dict:
    with open(json_path, encoding="utf-8") as f:
        return json.load(f)


@functools.cache
def special(json_path: str) -> tuple[str, int] | None:
    """The text that a tokenizers file takes as one id wherever it stands; a file
    with several isn't ``proven_equal``."""
    for t in specification(json_path).get("added_tokens") or []:
        return t["content"], t["id"]
    return None


@functools.cache
def size(json_path: str) -> int:
    """One more than the largest id of a tokenizers file."""
    return 1 + max([*specification(json_path)["model"]["vocab"].values(), *(t["id"] for t in specification(json_path).get("added_tokens") or [])])


#: The split of a ByteLevel step that names no pattern of its own.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def proven_equal(json_path: str, ranks_path: str) -> bool:
    """Whether the tokenizers file and the rank file are one vocabulary: the same
    bytes at each id, the k-th merge makes the k-th joined token, the same split
    before the merges, and added tokens that are cut out of a text as plain strings.
    Then ``text_ids`` gives the ids of the tokenizers library for every text, by the
    faster library."""
    spec = specification(json_path)
    letters, table = _byte_letters(), ranks(ranks_path)
    added = spec.get("added_tokens") or []
    own = {t["content"] for t in added}
    vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in own}
    if len(vocab) != len(table) or any(table.get(bytes(letters[c] for c in k)) != v for k, v in vocab.items()):
        return False
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    if any(vocab[a + b] != 256 + k for k, (a, b) in enumerate(merges)) or 256 + len(merges) != len(table):
        return False
    if len(own) > 1 or any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"] for t in added):
        return False
    pre = spec["pre_tokenizer"]
    plain = spec.get("normalizer") is None and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges")
    return plain and pre["type"] == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and pattern() == BYTE_LEVEL


#: Characters up to which a text is encoded at once.
AT_ONCE = 200_000
def text_ids(text: str, path: str, special: tuple[str, int] | None = None) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit integers; exact for any length. The
    text of ``special`` is its id wherever it stands, and what is between is encoded
    by itself, as in the tokenizers library's own call."""
    if len(text) <= AT_ONCE:
        return encoding(path, special).encode_to_numpy(text, allowed_special="all") if special else np.array(encoding(path).encode_ordinary(text), np.uint32)
    from tessera.llm.bpe import encode_tree

    parts = [encode_tree(x, path) for x in (text.split(special[0]) if special else [text])]
    if len(parts) == 1:
        return parts[0]
    mark = np.array([special[1]], np.uint32)
    return np.concatenate([x for p in parts for x in (mark, p)][1:])
