"""Token ids and counts as the tokenizer libraries give them, with pre-tokens looked up in bounded caches.

A byte-level BPE file whose merges are in rank order is encoded pre-token by pre-token: texts of ASCII
and Latin letters are split by one explicit pattern, equal pre-tokens are looked up. Every other text,
every text that holds a special token's string, and every other kind of file goes to its library whole.
"""

from __future__ import annotations

import json
import re

import numpy as np

_LETTER, _BLANK = "A-Za-zÀ-ÖØ-öø-ſ", "\\t-\\r "
#: The byte-level pre-token pattern, for texts without characters that OTHER finds.
PIECES = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[0-9]+| ?[^{_BLANK}{_LETTER}0-9]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
OTHER = re.compile(f"[^\\t-\\r -~{_LETTER}«»¿¡–—‘’“”„…€]")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in -> byte: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes with the file at ``path``; at most ``limit`` pre-tokens are cached in a worker."""

    def __init__(self, path: str, limit: int = 250_000):
        self.path, self.limit, self.core = path, limit, None
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            self.pieces = SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.core = self._core(spec)
        self.lengths, self.ids = _Lengths(self), _Ids(self)

    @staticmethod
    def _core(spec: dict):
        """The same merges as ranks, or None where the file is of another kind."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout")
        if not plain or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            return None
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        alphabet, special = byte_alphabet(), {t["content"] for t in spec.get("added_tokens") or []}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or len(vocab) != 256 + len(merges):
            return None
        import tiktoken

        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("file", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def plain(self, text: str) -> bool:
        return self.core is not None and not OTHER.search(text) and not any(s in text for s in self.special)

    def count(self, text: str) -> int:
        if self.plain(text):
            return sum(map(self.lengths.__getitem__, PIECES.findall(text)))
        return len(self._whole(text))

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit."""
        if self.plain(text):
            return np.frombuffer(b"".join(map(self.ids.__getitem__, PIECES.findall(text))), dtype="<u4")
        return np.asarray(self._whole(text), dtype="<u4")

    def _whole(self, text: str) -> list[int]:
        if self.path.endswith(".model"):
            return self.pieces.encode([text], num_threads=1)[0]
        return self.library.encode(text, add_special_tokens=False).ids

    def learn(self, lengths: dict[str, int]) -> None:
        """Fills the first tier of the lookup."""
        if self.core is not None:
            self.lengths.update(lengths)


class _Lengths(dict):
    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> int:
        value = len(self.owner.core.encode_single_piece(piece.encode()))
        if len(self) < self.owner.limit:
            self[piece] = value
        return value


class _Ids(_Lengths):
    def __missing__(self, piece: str) -> bytes:
        value = np.array(self.owner.core.encode_single_piece(piece.encode()), dtype="<u4").tobytes()
        if len(self) < self.owner.limit:
            self[piece] = value
        return value


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``; its caches live as long as the worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
