"""Token ids of whole texts with a tokenizer file of the `tokenizers` library.

Encoding a text is cut into pieces between which the tokenizer cannot see (white space and,
in the end of a piece, marks), the library encodes each distinct piece once, and ids of
texts are put together from a bounded cache. A text whose pieces might not be independent is
encoded whole. The ids equal those of `encode(text, add_special_tokens=False)`.
"""

from __future__ import annotations

import gc
import json
import os
import re
from itertools import compress, pairwise

import numpy as np

#: Code points that a Unicode-aware pattern takes as white space though bytes patterns do not.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_BYTE_PIECE = re.compile(rb" ?[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+")
#: Marks that may end a piece; no apostrophe, which starts contractions.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: ASCII letters and numbers, by byte.
_LETTER = [chr(c).isalnum() and c < 128 for c in range(256)]

_ENCODERS: dict[str, PieceEncoder] = {}


def _ends_in_letter(piece: bytes) -> bool:
    """Whether the last character is a letter or a number, in lower case too."""
    if piece[-1] < 128:
        return piece[-1:].isalnum()
    last = piece.decode("utf8")[-1]
    return last.isalnum() and last.lower()[-1].isalnum()


def encoder(path: str) -> PieceEncoder:
    """The encoder of a tokenizer file, one in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


class PieceEncoder:
    def __init__(self, path: str, most_cached: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_cached = most_cached
        self.cache: dict[bytes, bytes] = {}
        with open(path, encoding="utf8") as f:
            data = json.load(f)
        before = data.get("pre_tokenizer") or {}
        parts = before.get("pretokenizers", [before])
        self.specials = [t["content"].encode() for t in data.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        kinds = [p.get("type") for p in parts]
        vocabulary = self.tokenizer.get_vocab()
        self.marked = np.zeros(max(vocabulary.values()) + 1, bool)
        if not data.get("normalizer") and kinds == ["ByteLevel"] and before.get("use_regex") and not before.get("add_prefix_space"):
            self.mode = "byte"
        elif kinds == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and self._lowers(data):
            self.mode = "word"
        else:
            self.mode = "whole"
        # Tokens that begin a piece (its blank) in byte mode, that end one in word mode.
        self.marked[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if self.mode == "byte" else t.endswith("</w>"))]] = True

    @staticmethod
    def _lowers(data: dict) -> bool:
        return [n["type"] for n in (data.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, keys: set[bytes]) -> None:
        """Encode those of the keys that the cache lacks. Keys of letters only go to the library
        many at a time: each is one pre-token, and a token's mark tells where it begins or ends."""
        cache, new = self.cache, [k for k in keys if k not in self.cache]
        # Letters of ASCII are told apart at once, the others after decoding.
        if self.mode == "byte":
            plain = [k for k in new if k[:1] == b" " and k[1:].isalpha()]
            other = [k for k in new if not (k[:1] == b" " and k[1:].isalpha())]
            joins = [k[:1] == b" " and not k.isascii() and k[1:].decode("utf8").isalpha() for k in other]
        else:
            plain = [k for k in new if k.isalpha()]
            other = [k for k in new if not k.isalpha()]
            joins = [not k.isascii() and k.decode("utf8").isalpha() for k in other]
        plain += compress(other, joins)
        rest = [k for k, j in zip(other, joins, strict=True) if not j]
        gap = b"" if self.mode == "byte" else b" "
        groups = [plain[at : at + 128] for at in range(0, len(plain), 128)]
        encoded = self.tokenizer.encode_batch_fast([gap.join(g).decode("utf8") for g in groups], add_special_tokens=False)
        for group, e in zip(groups, encoded, strict=True):
            ids = np.array(e.ids, self.dtype)
            marks = np.flatnonzero(self.marked[ids])
            if len(marks) != len(group):
                rest += group
                continue
            cuts = np.append(marks, len(ids)) if self.mode == "byte" else np.append(0, marks + 1)
            raw, places = ids.tobytes(), (cuts * self.dtype.itemsize).tolist()
            cache.update(zip(group, [raw[a:b] for a, b in pairwise(places)], strict=True))
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            cache.update(zip(part, self._library([k.decode("utf8") for k in part]), strict=True))

    def _miss(self, pieces: set[bytes], specials: bool) -> None:
        """Learn pieces: marks at the end of a piece are tokens of their own, and in word mode
        capitals do not matter, so most new pieces are put together from known ones. specials:
        whether the texts may hold special tokens."""
        cache, word = self.cache, self.mode == "word"
        cut: dict[bytes, tuple[bytes, ...]] = {}
        whole = {p for p in pieces if b"<|" in p} if specials else set()
        plain = set(whole)
        if word:
            lowered = {p: p.lower() for p in pieces if p not in whole}
            cut.update((p, (k,)) for p, k in lowered.items() if k != p)
        else:
            lowered = {p: p for p in pieces if p not in whole} if whole else dict.fromkeys(pieces)
        plain.update(k or p for p, k in lowered.items() if _LETTER[p[-1]])
        for p, k in lowered.items():
            if _LETTER[p[-1]]:
                continue
            key = k or p
            bare = key.rstrip(_MARKS)
            if len(bare) == len(key) or not bare.strip() or not _ends_in_letter(bare):
                plain.add(key)
            else:
                cut[p] = (bare, key[len(bare) :])
                plain.update(cut[p])
        self._known(plain)
        for p, parts in cut.items():
            cache[p] = cache[parts[0]] if len(parts) == 1 else cache[parts[0]] + cache[parts[1]]

    def encode(self, raw: bytes) -> bytes:
        """The ids of one text in UTF-8, as little-endian numbers of self.dtype."""
        return self.encode_many([raw])[0]

    def encode_many(self, texts: list[bytes], chunk: int = 1 << 15) -> list[bytes]:
        """The ids of several texts. Texts are worked on in runs of about `chunk` bytes, so
        that new pieces reach the library together."""
        out: list[bytes] = []
        run: list[bytes] = []
        size = 0
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the lists of pieces would be searched again and again
        try:
            for raw in texts:
                run.append(raw)
                size += len(raw)
                if size >= chunk:
                    out += self._run(run)
                    run, size = [], 0
            return out + self._run(run)
        finally:
            if collects:
                gc.enable()

    def _run(self, texts: list[bytes]) -> list[bytes]:
        if len(self.cache) > self.most_cached:
            self.cache.clear()
        out: list[bytes | None] = [None] * len(texts)
        cut: list[list[bytes]] = [[]] * len(texts)
        whole, seen, specials = [], set(), False
        for i, raw in enumerate(texts):
            if self.mode == "whole" or self.mode == "byte" and self._unsafe(raw):
                whole.append(i)
                continue
            specials = specials or b"<|" in raw
            cut[i] = raw.split() if self.mode == "word" else _BYTE_PIECE.findall(raw)
            seen.update(cut[i])
        for i, ids in zip(whole, self._library([texts[i].decode("utf8") for i in whole]), strict=True):
            out[i] = ids
        fresh = seen.difference(self.cache)
        long = {p for p in fresh if len(p) > 256}  # not worth keeping
        self._miss(fresh - long if long else fresh, specials)
        get = self.cache.__getitem__
        once = dict(zip(long, self._library([p.decode("utf8") for p in long]), strict=True))
        for i, pieces in enumerate(cut):
            if out[i] is None:
                out[i] = b"".join([once[p] if p in once else get(p) for p in pieces]) if once else b"".join(map(get, pieces))
        return out

    def _unsafe(self, raw: bytes) -> bool:
        if any(s in raw for s in self.specials):
            return True
        return bool(_ODD_SPACE.search(raw.decode("utf8"))) if not raw.isascii() else any(c in raw for c in (b"\x1c", b"\x1d", b"\x1e", b"\x1f"))
