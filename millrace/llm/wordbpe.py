"""Token ids of whole texts by a public word-level BPE file, through a cache of words.

The tokenizer drops white space and never merges across it, so a text's ids are those
of its space-separated words in a row. Words repeat, so most cost one dictionary look-up.
"""

from __future__ import annotations

import json
import re
from array import array

#: Words that a Python worker remembers; later ones are encoded each time.
CACHE_WORDS = 700_000

#: str.split() takes these for white space and the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")
#: A comma or stop that isn't a run of signs of its own.
_SIGNS = re.compile(r"[^\w\s][,.]\s|_[,.]\s")
#: One run of lower-case Latin letters.
_STEM = re.compile("[a-zß-öø-ÿ]+")
#: Words encoded in one call.
_CALL = 256


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    """Ids as little-endian unsigned 32-bit bytes; equal to Tokenizer.encode(text, add_special_tokens=False)."""

    _open: dict[str, WordBpe] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.ends = frozenset(i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>"))
        # The same merges without the steps that do nothing to a lower-case run of letters.
        bare = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        # Byte-level alphabet: bytes that print stand for themselves, the others follow from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = (b for b in range(256) if b not in shown)
        self.bytes_as = {b: 256 + i for i, b in enumerate(hidden)}

    @classmethod
    def of(cls, path: str) -> WordBpe:
        """The worker's tokenizer for a path, opened once."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _spelt(self, stem: str) -> str:
        return stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.bytes_as)

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words; runs of letters many in one call, split where a word ends."""
        out: dict[str, bytes] = {}
        is_stem, stems = _STEM.fullmatch, []
        for w in words:
            if is_stem(w):
                stems.append(w)
            else:
                out[w] = self.whole(w)
        for i in range(0, len(stems), _CALL):
            call = stems[i : i + _CALL]
            ids = self.bare.encode(" ".join(map(self._spelt, call)), add_special_tokens=False).ids
            at, done = 0, []
            for j, x in enumerate(ids, 1):
                if x in self.ends:
                    done.append(array("I", ids[at:j]).tobytes())
                    at = j
            if len(done) != len(call):
                done = [self.whole(s) for s in call]
            out.update(zip(call, done, strict=True))
        return out

    @staticmethod
    def _words(text: str) -> list[str] | None:
        """Words whose ids make up the text's; None if white space can't part them.

        Latin-1 texts are in normal form, so lower case may come first; commas and stops
        that stand alone after a word are tokens of their own and may be parted from it.
        """
        if _ODD.search(text):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        text = text.lower()
        if not _SIGNS.search(text):
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; a text is looked up at once, and only one with unknown words is looked at word by word."""
        cache, out = self.cache, []
        get = cache.__getitem__
        for text in texts:
            words = self._words(text)
            if words is None:
                out.append(self.whole(text))
                continue
            try:
                out.append(b"".join(map(get, words)))
            except KeyError:
                fresh = self._learn({w for w in words if w not in cache})
                if len(cache) < CACHE_WORDS:
                    cache.update(fresh)
                    out.append(b"".join(map(get, words)))
                else:
                    out.append(b"".join([fresh[w] if w in fresh else cache[w] for w in words]))
        return out
