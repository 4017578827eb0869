"""Token ids of texts inside Python workers.

The vocabulary file is a parameter; it is opened once per worker.  A vocabulary
whose pre-tokenizer drops white space encodes each blank-separated word on its
own, so each distinct word of a slice of texts is looked up once and its ids are
laid out by array operations.  A Latin-1 word is the pieces that the
pre-tokenizer's pattern finds in it; new pieces are encoded many at a time, as
one text, and told apart by the marks that end a piece.  Other words, and whole
texts of other vocabularies, are encoded one by one.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Words and pieces remembered per worker (about 120 MB); on overflow the memory starts anew.
REMEMBERED = 600_000
_JOINED = 2000
#: Bytes of text encoded at a time; arrays of some twenty times that size come and go.
SLICE = 2 << 20


class Encoder:
    """Ids of a column of texts as one flat array."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._limit = remembered
        self._known: dict[str, bytes] = {"": b""}
        self.vocabulary = self._tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        first = steps[0] if steps else {}
        pattern = first.get("pattern", {}).get("Regex", "")
        special = [t["content"] for t in spec.get("added_tokens", [])]
        spaced = any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens", []))
        self._by_word = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and "^\\s" in pattern and not spaced
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self._lowers = self._by_word and "Lowercase" in kinds and set(kinds) <= {"NFC", "Replace", "Lowercase"}
        self._pieces = regex.compile(pattern).findall if self._by_word else None
        self._special = regex.compile("|".join(map(regex.escape, special)), regex.IGNORECASE).search if special else lambda text: None
        self._letters = r"\p{L}]+" in pattern and not any(s.isalpha() for s in special)  # a word of letters is one piece
        mark = spec.get("model", {}).get("end_of_word_suffix")
        self._ends = np.zeros(self.vocabulary, bool)
        if mark:
            self._ends[[k for word, k in self._tokenizer.get_vocab(with_added_tokens=False).items() if word.endswith(mark)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of the pattern, from texts of many pieces; each ends with its one id that has the mark."""
        out = []
        for low in range(0, len(pieces), _JOINED):
            own = pieces[low : low + _JOINED]
            ids = np.array(self._tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != len(own) or (len(ends) and ends[-1] != len(ids)):
                out.extend(self._encode(own))
                continue
            held, edges = ids.tobytes(), [0, *(4 * ends).tolist()]
            out.extend(held[a:b] for a, b in zip(edges, edges[1:]))  # noqa: B905
        return out

    def _learn(self, words: list[str]) -> None:
        """Latin-1 words are composed of their pieces (composition and case of such letters are settled), others encoded whole."""
        known, column = self._known, pa.array(words, pa.large_string())
        plain = pc.match_substring_regex(column, r"(?s)\A[\x{00}-\x{ff}]*\z") if self._lowers else pa.repeat(False, len(words))
        letters = pc.and_(plain, pc.utf8_is_alpha(column)) if self._letters else pa.repeat(False, len(words))
        alone, rest = column.filter(letters), column.filter(pc.and_not(plain, letters)).to_numpy(zero_copy_only=False).tolist()
        lowered, own = pc.utf8_lower(alone).to_numpy(zero_copy_only=False).tolist(), [w for w in rest if not self._special(w)]
        whole = column.filter(pc.invert(plain)).to_numpy(zero_copy_only=False).tolist() + [w for w in rest if self._special(w)]
        split = [self._pieces(w.lower()) for w in own]
        new = [p for p in set(lowered).union(*split) if p not in known]
        known.update(zip(whole, self._encode(whole), strict=True))
        known.update(zip(new, self._encode_pieces(new), strict=True))
        known.update(zip(alone.to_numpy(zero_copy_only=False).tolist(), map(known.__getitem__, lowered), strict=True))
        known.update((w, b"".join([known[p] for p in pieces])) for w, pieces in zip(own, split, strict=True))

    def _distinct(self, words: list[str]) -> list[bytes]:
        known = self._known
        held = list(map(known.get, words))
        new = [w for w, x in zip(words, held, strict=True) if x is None]
        if new:
            if len(known) + 2 * len(new) > self._limit:
                known.clear()
                new = words
            self._learn(new)
            held = [known[w] if x is None else x for w, x in zip(words, held, strict=True)]
        return held

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and where each text's begin (one more than texts); every text ends with ``end_id``, a null one is that alone."""
        n = len(texts)
        texts = texts.cast(pa.large_string()).fill_null("")
        if self._by_word:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            edges = np.asarray(lists.offsets, np.int64) - (lists.offsets[0].as_py() if n else 0)
            named = lists.flatten().dictionary_encode()
            held, code = self._distinct(named.dictionary.to_numpy(zero_copy_only=False).tolist()), np.asarray(named.indices)
        else:
            held, code, edges = self._encode(texts.to_numpy(zero_copy_only=False).tolist()), np.arange(n), np.arange(n + 1)
        own = np.fromiter(map(len, held), np.int64, len(held)) // 4
        flat, start = np.frombuffer(b"".join(held), "<u4"), np.cumsum(own) - own
        size = own[code]
        before = np.r_[0, np.cumsum(size)]
        ids = flat[np.repeat(start[code] - before[:-1], size) + np.arange(before[-1])] if len(flat) else flat
        offsets = before[edges] + np.arange(n + 1)
        out, inner = np.full(len(ids) + n, end_id, "<u4"), np.ones(len(ids) + n, bool)
        inner[offsets[1:] - 1] = False
        out[inner] = ids
        return out, offsets


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def id_dtype(vocabulary: int) -> str:
    """Narrowest flat unsigned type that holds every id."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"
