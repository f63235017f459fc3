"""Vocabulary files and memoised encoding shared by token counting and packing.

Words repeat, so each Python worker keeps a bounded memo from a chunk of text to
what the tokenizer library returns for it; chunks are cut only where the
tokenizer's own pre-tokenizer always cuts, so sums over chunks equal whole-text
results.  The memo is emptied when it is full, which costs time and never results.
"""

from __future__ import annotations

import json
import os
import re

MEMO_ENTRIES = 700_000
ENCODE_BYTES = 256_000  # bytes a call of the library gets at once


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """Missing keys are noted in ``wanted`` and read as ``blank`` until ``fill`` has encoded them."""

    def __init__(self, blank):
        super().__init__()
        self.blank, self.wanted = blank, []

    def __missing__(self, key):
        self.wanted.append(key)
        return self.blank

    def trim(self) -> None:
        if len(self) > MEMO_ENTRIES:
            self.clear()


def by_bytes(items: list, size, limit: int = ENCODE_BYTES):
    """Runs of ``items`` of about ``limit`` bytes each."""
    run, total = [], 0
    for x in items:
        run.append(x)
        total += size(x)
        if total >= limit:
            yield run
            run, total = [], 0
    if run:
        yield run


_LOADED: dict[str, object] = {}


def load(path: str):
    """The library's tokenizer of a ``.json`` or ``.model`` file, once per Python worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already has a worker for each core
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def spaces_are_safe(path: str) -> bool:
    """True for byte-level BPE with its default word pattern: a single space between two other characters starts a token."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = all(" " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    return plain and not spec.get("normalizer") and not spec.get("post_processor") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


#: fixed values: normalizers and word pattern of lower-case word vocabularies
_WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def words_are_safe(path: str) -> bool:
    """True for lower-case BPE in which letters, single digits and other runs are pieces that end with an end-of-word token.

    Then white space never joins words, A-Z may be lower-cased first, and punctuation behind a letter is a piece of its own.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    plain = all(t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens", []))
    pieces = pre[0].get("type") == "Split" and pre[0].get("pattern") == {"Regex": _WORD_PATTERN} and pre[0].get("invert") and pre[0].get("behavior") == "Removed"
    bytes_ = len(pre) == 2 and pre[1].get("type") == "ByteLevel" and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")
    normal = (spec.get("normalizer") or {}).get("normalizers") == _WORD_NORMALIZERS
    return bool(plain and pieces and bytes_ and normal and not spec.get("post_processor") and spec["model"].get("end_of_word_suffix") == "</w>")


_DOUBTFUL = re.compile(r"\s | \s|^ | $")
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def safe_chunks(text: str) -> list[str]:
    """Pieces between safe spaces; every piece but the first belongs behind one space."""
    return _SAFE.split(text) if _DOUBTFUL.search(text) else text.split(" ")
