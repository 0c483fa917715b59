"""Splitting into tokenizer words. Texts of common Latin characters take a faster, equal pattern of the standard library."""

from __future__ import annotations

import re

import regex

LETTERS = "A-Za-zÀ-ÖØ-öø-įıĲ-ſ"
PLAIN = re.compile(f"[^\\t-\\r -~{LETTERS}]")


def splitter(pattern: str, plain: str):
    slow, fast = regex.compile(pattern).findall, re.compile(plain).findall
    return lambda text: (slow if PLAIN.search(text) else fast)(text)


def plain_of(pattern: str) -> str:
    """The same pattern over common Latin characters only."""
    return pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^\\s0-9{LETTERS}]").replace("[\\p{L}]", f"[{LETTERS}]").replace("[\\p{N}]", "[0-9]").replace("\\p{L}", f"[{LETTERS}]").replace("\\p{N}", "[0-9]")


def byte_characters() -> dict[int, str]:
    """The character that byte-level tokenizers write for each byte: itself where it is printable in Latin-1, else those from 256 on, in order."""
    out, spare = {}, 256
    for b in range(256):
        if chr(b).isprintable() and b != 32:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out
