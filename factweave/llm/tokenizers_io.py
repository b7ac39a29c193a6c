"""Loading public tokenizer files, and encoding with them in Python workers."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

#: The pre-tokenizer's pattern of byte-level BPE files that split by regular expression.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space in a row from which a text may overrun the faster library's pattern search, whose stack grows with it.
LONG_SPACE = 4096
_LONG_SPACE = re.compile(r"(?<!\s)\s{%d}" % LONG_SPACE)


def long_space(text: str) -> bool:
    """Whether a text has LONG_SPACE characters of white space in a row."""
    if len(text) < LONG_SPACE:
        return False
    words = text.split()
    # white space beyond one character between words: only a text with much of it is searched
    return len(text) - sum(map(len, words)) - len(words) + 1 >= LONG_SPACE - 1 and _LONG_SPACE.search(text) is not None


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer's bytes, small and of fixed size: sent to workers as they are."""

    kind: str
    data: bytes
    version: str

    @staticmethod
    def read(path: str | None = None) -> TokenizerFile:
        path = path or default_path()
        data = Path(path).read_bytes()
        kind = Path(path).suffix.lstrip(".")
        if kind not in ("json", "model", "tiktoken"):
            raise ValueError(f"no library for tokenizer files of kind {kind!r}")
        return TokenizerFile(kind, data, hashlib.sha256(kind.encode() + b"\0" + data).hexdigest())


def byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes each byte as one printable character."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes whole texts without begin, end or other added tokens.

    Special strings inside a text are handled as the file's library does by
    default. Byte-level BPE files with the common settings (no normaliser, the
    common split pattern, merges in the order of their ids) are encoded by the
    faster of two public libraries that give the same ids; tests compare both
    on every code point. Other files go to their own library.
    """

    def __init__(self, file: TokenizerFile):
        self.file = file
        self.pieces: dict[int, bytes] = {}
        self._library = self._fast = None
        self.special: dict[str, int] = {}
        if file.kind == "json":
            self._json(json.loads(file.data))
        elif file.kind == "tiktoken":
            self._ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, file.data.splitlines())}, {})
        else:
            import sentencepiece

            self._library = sentencepiece.SentencePieceProcessor(model_proto=file.data)

    def _ranks(self, ranks: dict[bytes, int], special: dict[str, int]) -> None:
        import tiktoken

        self.special = special
        self._fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.pieces = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in special.items()}

    def _json(self, spec: dict) -> None:
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_str(self.file.data.decode())
        self._library.no_truncation()
        self._library.no_padding()
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        added = spec.get("added_tokens", [])
        if not (
            model.get("type") == "BPE"
            and plain
            and spec.get("normalizer") is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex")
            and not split.get("add_prefix_space")
            and (spec.get("decoder") or {}).get("type") == "ByteLevel"
            and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        ):
            return
        byte = byte_of_char()
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in merges]
        if ids == sorted(ids) and len(set(ids)) == len(ids):
            self._ranks(ranks, special)

    @property
    def byte_level(self) -> bool:
        return self._fast is not None

    def encode(self, text: str) -> list[int]:
        if self._fast is not None and not long_space(text):
            if any(s in text for s in self.special):
                return self._fast.encode(text, allowed_special="all")
            return self._fast.encode_ordinary(text)
        if self.file.kind == "model":
            return self._library.encode(text)
        if self.file.kind == "tiktoken":
            import regex

            return [i for piece in regex.findall(BYTE_LEVEL_PATTERN, text) for i in self._fast._core_bpe.encode_single_piece(piece.encode())]
        return self._library.encode(text, add_special_tokens=False).ids

    def count(self, text: str) -> int:
        return len(self.encode(text)) if text else 0

    def decode(self, ids: list[int]) -> str:
        if self._fast is not None:
            return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", errors="replace")
        if self.file.kind == "model":
            return self._library.decode(ids)
        return self._library.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=4)
def _cached(version: str, holder: tuple[TokenizerFile]) -> Encoder:
    return Encoder(holder[0])


def encoder(file: TokenizerFile) -> Encoder:
    """One encoder per file and Python worker."""
    return _cached(file.version, (file,))
