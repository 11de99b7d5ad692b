"""Vocabulary files of public tokenizers, read once on the driver and broadcast to the tasks.

The path is a parameter of every operator; files are never copied into the repository.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import public_tokenizers
import regex
from tokenizers import pre_tokenizers

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"

#: From here on, code points may have other classes in the regex module than in the tokenizers library.
FIRST_NEW = "\u0530"
_maybe_new = regex.compile(f"[{FIRST_NEW}-\U0010ffff]")


def vocabulary_json(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_path(name: str) -> str:
    return public_tokenizers.path(name)


def has_new(text: str) -> bool:
    """True if the text has code points assigned after the Unicode version of Python."""
    if text.isascii():
        return False
    return any(unicodedata.category(c) == "Cn" for c in set(_maybe_new.findall(text)))


@cache
def _stand_in(char: str) -> str:
    """A long-assigned character of the class that the tokenizers library gives ``char``."""
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    for like in "\u00aa\u00b2":  # a letter, a digit
        if len(split(like + char)) == 1:
            return like
    return "\u00b6"


def library_classes(text: str) -> str:
    """A text of the same length whose newer code points are replaced by ones of the same class.

    The libraries know different Unicode versions, so the class is asked from the tokenizers library.
    """
    new = [c for c in set(_maybe_new.findall(text)) if unicodedata.category(c) == "Cn"]
    return text.translate({ord(c): _stand_in(c) for c in new})


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the other bytes for the code points
    from 256 on, in order.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out
