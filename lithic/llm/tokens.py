"""Encoding whole texts with a public word-level BPE, exactly as the tokenizers library does, once for each distinct word.

The vocabulary drops white space, and no normalisation, special token or pre-token reaches across an ASCII blank, so the ids of
a text are the ids of its blank-separated words, one after the other. The words of a block of texts that no block before had are
parted into letters and marks and encoded together, and what was used lately is kept within bounds.
"""

from __future__ import annotations

import codecs
import os
import zlib
from array import array

from . import parts
from .common import held

END_ID = 1
#: Words whose ids a worker keeps in each of two generations, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 150_000, 40
#: Fixed by the vocabulary: how a token ends that ends a word.
WORD_END = "</w>"

class Known(dict):
    """Values of the keys of a block of texts, made together for those that are new; two generations, the elder goes when the younger is full."""

    def __init__(self, make, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def learn(self, wanted: set) -> None:
        """Afterwards each wanted key is here. A key that was learnt before may go."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        lacking = wanted - self.keys()
        kept = lacking & self.old.keys()
        for key in kept:
            self[key] = self.old[key]
        lacking -= kept
        self.update(self.make(list(lacking)))


class WordEncoder:
    """ids of texts as unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # How the byte-level alphabet writes each byte: a letter of Latin-1 is two of them.
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        pairs = {chr(x): byte_level.pre_tokenize_str(chr(x))[0][0] for x in range(0xC0, 0x100)}
        spelled = {byte: spelling for c, two in pairs.items() for byte, spelling in zip(c.encode(), two)}
        self.spelled = "".join(spelled.get(i, chr(i)) for i in range(256))
        # The same model over words that are spelled already; each word's last token is known by its ending.
        self.speller = Tokenizer(self.tokenizer.model)
        self.speller.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.cores, self.others = Known(self.make_cores), Known(lambda found: {x: self.whole(x) for x in found})

    def whole(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids).tobytes()

    def make_cores(self, cores: list[bytes]) -> dict[bytes, bytes]:
        """Words of plain lower-case letters, many in one call."""
        import numpy as np

        found = {}
        for k in range(0, len(cores), 20_000):
            part = cores[k : k + 20_000]
            lines = [codecs.charmap_decode(b" ".join(part[i : i + 400]), "strict", self.spelled)[0] for i in range(0, len(part), 400)]
            ids = np.concatenate([np.array(x.ids, "<u4") for x in self.speller.encode_batch_fast(lines, add_special_tokens=False)])
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(part):
                raise ValueError("the vocabulary does not mark the ends of words")
            data = ids.tobytes()
            found.update(zip(part, (data[a:b] for a, b in zip([0, *ends], ends))))
        return found

    def encode_all(self, column, end_id: int = END_ID):
        """The ids of all texts of an Arrow column, each text with the end id, one after the other; each text's first id (with the end of
        the last)."""
        import numpy as np
        import pyarrow as pa

        cores, marks, others, codes, bounds = parts.cored(*parts.words(column, b" \n\t\r"), lower=True)
        self.cores.learn(set(cores))
        self.others.learn({*others, *marks})
        values = [*map(self.cores.__getitem__, cores), *map(self.others.__getitem__, [*marks, *others]), end_bytes(end_id)]
        codes, bounds = np.insert(codes, bounds[1:], len(values) - 1), bounds + np.arange(len(bounds))
        data, at = parts.joined(pa.array(values, pa.large_binary()), codes, bounds)
        return np.frombuffer(data, "<u4"), at // 4

    def encode(self, text: str | None) -> bytes:
        import pyarrow as pa

        return self.encode_all(pa.array([text], pa.string()))[0][:-1].tobytes()


def encoder(path: str) -> WordEncoder:
    """One for each worker process and vocabulary."""
    return held(("words", path), lambda: WordEncoder(path))


def end_bytes(end_id: int = END_ID) -> bytes:
    return end_id.to_bytes(4, "little")


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
