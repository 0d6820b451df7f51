"""Token ids of whole texts, made by the tokenizers library inside Spark tasks."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: White space besides the space and the line break.
_ASCII_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_OTHER_SPACE = _ASCII_SPACE + "\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
#: Longer words are seldom seen twice.
_KEPT_CHARS = 40
#: Bytes of text, about, that callers hand over in a batch.
CHARS_AT_ONCE = 8_000_000
#: Words that the library gets in one text.
_WORDS_AT_ONCE = 20_000


def plain(text: str) -> bool:
    """Words with single spaces or line breaks between them, and no other white space."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in (_ASCII_SPACE if text.isascii() else _OTHER_SPACE))


class WordEncoder:
    """Encodes batches of texts word by word and remembers the ids of frequent words.

    A byte-level pre-tokenizer cuts before every single space or line break that
    follows a visible character, whatever its Unicode tables are, so a word's ids
    with the separator before it do not depend on its neighbours.  The words of a batch
    are numbered, each different one is looked up once, and the ids of all texts are
    gathered by number.  Words that are not remembered are encoded together and parted
    where an id begins with the separator.  Texts with other white space, or with the
    content of an added token, go to the library as they are.  Two generations of at
    most ``kept_words`` words are remembered; words in use move to the younger one.
    Only for tokenizers whose pre-tokenizer is byte level, without normalizer.
    """

    def __init__(self, path: str, kept_words: int = 400_000):
        # A task has one core; threads of the library's own would fight over it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if type(self.tokenizer.pre_tokenizer).__name__ != "ByteLevel" or self.tokenizer.normalizer is not None:
            raise ValueError("words are cut for byte-level tokenizers without a normalizer")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(c in added for added in self.added for c in " \n"):
            raise ValueError("an added token holds a separator of words")
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id's bytes begin with a space, or with a line break.
        self.spaced, self.broken = np.zeros((2, max(vocabulary.values()) + 1), dtype=bool)
        for mark, opens in ((" ", self.spaced), ("\n", self.broken)):
            (sign,) = {self.tokenizer.id_to_token(int(i))[0] for i in self._encode(mark)}
            opens[[i for token, i in vocabulary.items() if token[0] == sign]] = True
        self.kept_words = kept_words
        #: A key is a word that follows a space, or a line break and the word behind it.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: Words that begin a text.
        self.first: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        (made,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(made.ids, dtype="<u4")

    def _parts(self, text: str, opens: np.ndarray) -> list[bytes]:
        """Ids of a text before its first separator, and from each on to the next."""
        ids = self._encode(text)
        raw = ids.tobytes()
        cuts = (np.flatnonzero(opens[ids]) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of different words, each with the separator before it."""
        found = list(map(self.young.get, words))
        spaced, lines = [], []
        for k, ids in enumerate(found):
            if ids is None:
                found[k] = ids = self.old.get(words[k])
                if ids is None:
                    (lines if words[k][0] == "\n" else spaced).append(k)
                elif len(words[k]) <= _KEPT_CHARS:
                    self.young[words[k]] = ids
        for missing, opens, glue in ((spaced, self.spaced, " "), (lines, self.broken, "")):
            for a in range(0, len(missing), _WORDS_AT_ONCE):
                some = missing[a : a + _WORDS_AT_ONCE]
                made = self._parts("x" + glue + glue.join([words[k] for k in some]), opens)[1:]
                for k, ids in zip(some, made, strict=True):
                    found[k] = ids
                    if len(words[k]) <= _KEPT_CHARS:
                        self.young[words[k]] = ids
        if len(self.young) > self.kept_words:
            self.old, self.young = self.young, {}
        return found

    def _firsts(self, words: list[str]) -> list[bytes]:
        """Ids of different words that begin a text."""
        if len(self.first) > self.kept_words // 4:
            self.first = {}
        for w in words:
            if w not in self.first:
                self.first[w] = self._encode(w).tobytes()
        return [self.first[w] for w in words]

    def _plain_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids after each other and their number by text, for texts with plain separators."""
        lists = pa.compute.split_pattern(pa.compute.replace_substring(texts, "\n", " \n"), " ")
        begin = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        words, number = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        opening, which = np.unique(number[begin[:-1]], return_inverse=True)
        number[begin[:-1]] = len(words) + which
        held = self._firsts([words[k] for k in opening.tolist()])
        held = self._words(words) + held
        pool = np.frombuffer(b"".join(held), dtype="<u4")
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        place = np.cumsum(size) - size
        count = size[number]
        before = np.cumsum(count) - count
        ids = pool[np.repeat(place[number] - before, count) + np.arange(int(count.sum()))]
        return ids, np.add.reduceat(count, begin[:-1])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after each other, as little-endian 32-bit integers, and the
        number of ids of each text; null is empty."""
        raw = texts.to_pylist()
        simple = np.array([bool(t) and plain(t) and not any(a in t for a in self.added) for t in raw], dtype=bool)
        lengths = np.zeros(len(raw), dtype=np.int64)
        ids = np.empty(0, dtype="<u4")
        if simple.any():
            ids, lengths[simple] = self._plain_batch(texts.filter(pa.array(simple)))
        others = [k for k in np.flatnonzero(~simple).tolist() if raw[k]]
        if others:
            apart = [self._encode(raw[k]) for k in others]
            lengths[others] = [len(x) for x in apart]
            of_simple = np.repeat(simple, lengths)
            out = np.empty(len(of_simple), dtype="<u4")
            out[of_simple], out[~of_simple] = ids, np.concatenate(apart)
            ids = out
        return ids, lengths

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of one whole text."""
        return self.batch(pa.array([text], pa.string()))[0]


def with_ends(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of texts with an end id behind each of them."""
    longer = lengths + 1
    ends = np.cumsum(longer) - 1
    out = np.empty(len(ids) + len(lengths), dtype="<u4")
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    out[inside], out[ends] = ids, end_id
    return out, longer


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    return WordEncoder(path)


def release_words() -> None:
    """Lets go of what a Python worker still holds from encoding, its words and free memory.

    Spark hands a worker from stage to stage, so a stage that does not encode would hold
    the words of an earlier one beside its own.
    """
    word_encoder.cache_clear()
    release_buffers()


def release_buffers() -> None:
    """Gives memory of Arrow batches that are gone back to the system."""
    pa.default_memory_pool().release_unused()


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)
