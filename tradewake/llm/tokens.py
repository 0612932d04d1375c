"""Byte-level token ids of whole texts."""

from __future__ import annotations

import base64
import re
from array import array

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

# Characters encoded in one go.
STEP = 1 << 20

# A token never holds white space after anything else, so a text may be cut here.
_CUT = re.compile(r"(?<=\S)[ \n]")
# Latin, Greek and Cyrillic letters and common punctuation, about which both libraries
# agree whatever version of Unicode they know.
_COMMON = re.compile("[\x00-ӿ‐-⁞]*")


class Encoder:
    """Ids of the tokenizers library for a vocabulary file, as its plain call gives them.

    No special tokens are added; the strings of special tokens inside a text become their
    ids unless ``plain_text`` says that they are text like any other. ``ranks`` is the
    same vocabulary for tiktoken, which gives the same ids five times faster; it takes
    texts of common letters without such strings. All other texts go to tokenizers.
    """

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str | None = RANKS, plain_text: bool = False):
        self.exact = Tokenizer.from_file(vocabulary)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.exact.encode_special_tokens = plain_text
        added = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.special = None if plain_text or not added else re.compile("|".join(map(re.escape, added)))
        self.fast = None
        if ranks:
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )

    def numbers(self, text: str) -> list[int]:
        if self.fast is not None and (text.isascii() or _COMMON.fullmatch(text)):
            if self.special is None or not self.special.search(text):
                return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers.

        A long text is encoded in steps, cut before white space: no token and no special
        string has white space after anything else.
        """
        done, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + STEP)
            stop = cut.start() if cut else len(text)
            done.append(array("I", self.numbers(text[at:stop])).tobytes())
            at = stop
        return b"".join(done)
