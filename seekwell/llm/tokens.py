"""Token ids of whole texts by a public tokenizer file, with a table of words already met."""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Iterable, Iterator

TABLE_ROWS = 500_000
_PLAIN = re.compile(r"([a-z]+)([.,]?)")


class WordTable:
    """Ids of words between blanks, as little-endian unsigned 32-bit bytes.

    Only for tokenizers that drop white space and never merge across it, with A-Z lowered: then the ids of a text are
    those of its words in a row. At most ``TABLE_ROWS`` words are remembered; others are encoded each time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def _new(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if plain:  # letters and at most one mark: one or two pieces of the splitting rule, nothing to normalise
            model = self.tokenizer.model
            ids = [t.id for part in plain.groups() if part for t in model.tokenize(part)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass").replace("\n", " ").split(" ")
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            out = []
            for w in words:
                ids = known.get(w)
                if ids is None:
                    ids = self._new(w) if w else b""
                    if len(known) < TABLE_ROWS:
                        known[w] = ids
                out.append(ids)
            return b"".join(out)


def word_table(path: str) -> WordTable:
    """The table of this Python worker. Workers serve many tasks, so it is kept in the interpreter and not in the
    function, which every task unpickles anew."""
    kept = sys.modules.setdefault("_word_tables", types.ModuleType("_word_tables"))
    if path not in kept.__dict__:
        kept.__dict__[path] = WordTable(path)
    return kept.__dict__[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_all(texts: Iterable[str | None], path: str, end: bytes) -> Iterator[bytes]:
    """Ids of each text, then ``end``; one text at a time, so that a batch of ids is never held."""
    table = word_table(path)
    for t in texts:
        yield table.encode(t or "") + end
