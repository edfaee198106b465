"""Encoders over vocabulary files: the file's own library, and for vocabularies that drop white space a word cache."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept by each Python worker in either of two tables, plain ones by their parts: when the young one is full it
#: becomes the old one, so memory is bounded, common words stay, and results are the same.
WORDS_KEPT, PARTS_KEPT = 300_000, 400_000
#: Latin letters that lower-casing and NFC map one to one, then ASCII punctuation but the apostrophe: such a word is two
#: pieces, or one, for the splitter, and the first needs no more of the normaliser than lower case.
_PLAIN = "^(?P<word>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017f]+)(?P<rest>[!-&(-/:-@\\[-`{-~]*)$"
#: Bytes of text whose words are told apart at a time, and words whose ids are put in place at a time.
TOGETHER, PLACED = 4 << 20, 1 << 18


class TwoTables:
    """A mapping that forgets: the young table becomes the old one when full."""

    def __init__(self, kept: int):
        self.kept, self.young, self.old = kept, {}, {}

    def turn(self) -> None:
        if len(self.young) > self.kept:
            self.young, self.old = {}, self.young

    def values(self, keys: pa.Array, make: Callable[[pa.Array], list[bytes]]) -> list[bytes]:
        """What belongs to each of the distinct keys; `make` gives what is in neither table."""
        self.turn()
        own = as_list(keys.cast(pa.binary()))
        found = list(map(self.young.get, own))
        lacking = []
        for i in [i for i, v in enumerate(found) if v is None]:
            if (got := self.old.get(own[i])) is None:
                lacking.append(i)
            else:
                self.young[own[i]] = found[i] = got
        if lacking:
            for i, v in zip(lacking, make(keys.take(pa.array(lacking, pa.int64()))), strict=True):
                self.young[own[i]] = found[i] = v
        return found


def as_list(col: pa.Array) -> list:
    return col.to_numpy(zero_copy_only=False).tolist()


def drops_white(path: str) -> bool:
    """True if texts may be cut at ASCII white space without changing the ids: the normaliser works by character
    (NFC, white space to a space, lower case), the splitter keeps nothing of white space, and no added token holds any."""
    if not path.endswith(".json"):
        return False
    spec = json.load(open(path, encoding="utf-8"))
    steps = [(x.get("type"), (x.get("pattern") or {}).get("Regex")) for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = splits[0] if splits else {}
    return (
        steps == [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
        and first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "")
        and (splits[1].get("type"), splits[1].get("add_prefix_space"), splits[1].get("use_regex")) == ("ByteLevel", False, False)
        and not spec.get("post_processor")
        and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
    )


def lean(path: str) -> Callable[[pa.Array], list[bytes]]:
    """The file's model behind its byte mapping alone: for words that are one piece, lower-cased and composed already."""
    from tokenizers import Tokenizer, pre_tokenizers

    model, to_bytes = Tokenizer.from_file(path).model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    mapped = {c: to_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x180)}

    def run(words: pa.Array) -> list[bytes]:
        out = []
        for at in range(0, len(words), 4096):
            got = [model.tokenize(w if w.isascii() else w.translate(mapped)) for w in as_list(words.slice(at, 4096))]
            ends = (np.cumsum([len(x) for x in got]) * 4).tolist()
            raw = np.array([t.id for x in got for t in x], "<u4").tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    return run


class Encoder:
    """ids(texts) as little-endian unsigned 32-bit bytes, exactly as the library gives them, no special tokens added.
    Texts are UTF-8 bytes."""

    def __init__(self, path: str, words_kept: int = WORDS_KEPT):
        self.by_word, self.words, self.parts = drops_white(path), TwoTables(words_kept), TwoTables(PARTS_KEPT)
        self.mark, self.mark_id = "", -1
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self._many = lambda texts: [x.ids for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
            whole = [t for t in tok.get_added_tokens_decoder().items() if t[1].special and not t[1].normalized and not t[1].single_word]
            if self.by_word and whole:
                self.mark_id, self.mark = whole[0][0], whole[0][1].content
                self._lean = lean(path)
            self._all = lambda text: tok.encode_batch_fast([text], add_special_tokens=False)[0].ids
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self._many = lambda texts: sp.encode(texts, num_threads=1)

    def _pack(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in self._many([t.decode() for t in texts])]

    def _joined(self, words: pa.Array) -> list[bytes]:
        """Many words in one call, told apart by a special token of the vocabulary: the library cuts a text at special
        tokens before all else."""
        out = []
        for at in range(0, len(words), 1024):
            ids = np.array(self._all(self.mark.join(as_list(words.slice(at, 1024)))), "<u4")
            cut, raw = (np.flatnonzero(ids == self.mark_id) * 4).tolist(), ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(c + 4 for c in cut)], [*cut, len(raw)], strict=True)]
        return out

    def _odd(self, words: pa.Array) -> list[bytes]:
        alone = not self.mark or pc.any(pc.match_substring(words, self.mark)).as_py()
        return self._pack(as_list(words.cast(pa.binary()))) if alone else self._joined(words)

    def _words(self, words: pa.Array) -> list[bytes]:
        if not self.mark:
            return self.words.values(words, self._odd)
        halves = pc.extract_regex(words, _PLAIN)
        plain = halves.is_valid()
        out, halves, odd = np.empty(len(words), object), halves.filter(plain), words.filter(pc.invert(plain))
        first, rest = pc.utf8_lower(halves.field("word")).dictionary_encode(), halves.field("rest").dictionary_encode()
        a, b = self.parts.values(first.dictionary, self._lean), self.parts.values(rest.dictionary, self._joined)
        plain = plain.to_numpy(zero_copy_only=False)
        out[plain] = [a[i] + b[j] for i, j in zip(as_list(first.indices), as_list(rest.indices), strict=True)]
        out[~plain] = self.words.values(odd, self._odd)
        return out.tolist()

    def _by_word(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """Of about TOGETHER bytes at a time: the texts' first words and the end, each word's number, the numbers' ids."""
        lo, size = 0, 0
        for hi, text in enumerate(texts, 1):
            size += len(text)
            if size >= TOGETHER or hi == len(texts):
                words = pc.ascii_split_whitespace(pa.array(texts[lo:hi], pa.binary()).cast(pa.string()))  # the six of ASCII
                each = words.flatten().dictionary_encode()
                yield words.offsets.to_numpy(), each.indices.to_numpy(), self._words(each.dictionary)
                lo, size = hi, 0

    def ids(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return self._pack(texts)
        out: list[bytes] = []
        for begin, word, ids in self._by_word(texts):
            n, pool = np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), "<u4")
            first, edges, raw = np.cumsum(n) - n, sums(n[word])[begin], bytearray()
            for at in range(0, len(word), PLACED):
                own = word[at : at + PLACED]
                ends = np.cumsum(n[own])
                raw += pool[np.repeat(first[own] - ends + n[own], n[own]) + np.arange(ends[-1])].data
            edges = (edges * 4).tolist()
            out += [bytes(raw[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out

    def counts(self, texts: list[bytes]) -> list[int]:
        if not self.by_word:
            return [len(x) // 4 for x in self._pack(texts)]
        out: list[int] = []
        for begin, word, ids in self._by_word(texts):
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            out += np.diff(sums(n[word])[begin]).tolist()
        return out


def sums(n: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def forget() -> None:
    """Frees the tables that an earlier job left in this Python worker."""
    encoder.cache_clear()
