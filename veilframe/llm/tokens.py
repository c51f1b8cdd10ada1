"""Token ids of a public byte-level BPE vocabulary.

The ids are those of the ``tokenizers`` file. The same vocabulary as ranks, run by ``tiktoken``, is about
six times as fast, so it does the work; a text with characters whose class the two libraries' Unicode
tables may see differently is encoded by ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import functools
import os

import regex

#: Splitting rule of the vocabulary, with possessive runs, which match the same and never backtrack.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Latin, Greek, Cyrillic and general punctuation: classes that no Unicode version has changed since both libraries' tables.
_SETTLED = regex.compile(r"[\x00-ɏЀ-ҁ‐-‧‰-⁞€]*+")

VOCABULARY = "byte_bpe_50k"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Encoder:
    """Texts to ids and back.

    added: what the strings of added tokens in a text are. True gives their own ids, as the file's plain call does; False
    takes them as ordinary text. reserved: names of further ids, for texts from ids.
    """

    def __init__(self, exact_path: str, ranks_path: str | None = None, added: bool = False, reserved: dict[str, int] | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_file(exact_path)
        self._exact.encode_special_tokens = not added
        listed = self._exact.get_added_tokens_decoder()
        self._added = [t.content for t in listed.values()] if added else []
        self._fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
            spelled = {k: word for word, k in ranks.items()}
        else:
            byte = _byte_of_character()
            spelled = {k: bytes(byte[c] for c in word) for word, k in self._exact.get_vocab(False).items() if all(c in byte for c in word)}
        spelled |= {k: t.content.encode() for k, t in listed.items()}
        spelled |= {k: name.encode() for name, k in (reserved or {}).items()}
        self._spelled = [spelled.get(k, b"") for k in range(max(spelled, default=-1) + 1)]

    def exact(self, text: str) -> list[int]:
        return self._exact.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        if self._fast and _SETTLED.fullmatch(text) and not any(name in text for name in self._added):
            return self._fast.encode_ordinary(text)
        return self.exact(text)

    def text(self, ids) -> str:
        return b"".join(map(self._spelled.__getitem__, ids)).decode("utf-8", "surrogatepass")


@functools.lru_cache(4)
def encoder(exact_path: str | None = None, ranks_path: str | None = None, added: bool = False, reserved: tuple[tuple[str, int], ...] = ()) -> Encoder:
    """One encoder of a kind per Python worker."""
    if exact_path is None:
        exact_path, ranks_path = vocabulary_path(f"{VOCABULARY}.json"), vocabulary_path(f"{VOCABULARY}.tiktoken")
    return Encoder(exact_path, ranks_path, added, dict(reserved))
