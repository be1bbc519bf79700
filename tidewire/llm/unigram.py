"""Token counts of a unigram tokenizer without its tokens: a Viterbi pass that carries score and count only.

An Aho-Corasick automaton over the vocabulary gives every match that ends at a place. The best path to a place has
the highest sum of scores; of equal sums the one whose last piece begins first stays, as in the tokenizers library,
which fills places in order of the piece's begin and replaces only on a strictly better sum. A character that is no
piece itself can be passed as unknown at the lowest score less 10; unknown characters in a row are one token, or
as many as their bytes with byte fallback.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm.frames import arrow_map

# The mark for a blank, and what an unknown character costs beyond the lowest score.
BLANK, UNKNOWN_PENALTY = "▁", 10.0

#: Words whose counts one worker remembers.
MEMORY = 1_000_000


@dataclass
class CountingUnigram:
    """Counts the tokens that ``Unigram`` of the tokenizers library gives with a ``Metaspace`` split."""

    vocabulary: list[tuple[str, float]]
    unknown_id: int = 0
    byte_fallback: bool = True
    memory: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        score_of: dict[str, float] = {}
        for piece, score in self.vocabulary:
            score_of[piece] = score  # the last of equal pieces, as in the library's table
        for piece, score in score_of.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in score_of if len(p) == 1}
        self.unknown_score = min(s for _, s in self.vocabulary) - UNKNOWN_PENALTY
        bytes_known = all(f"<0x{b:02X}>" in score_of for b in range(256))
        self.bytes_known, self.score_of = bytes_known, score_of

    def _unknown_tokens(self, run: str) -> int:
        raw = run.encode()
        if self.byte_fallback and (self.bytes_known or all(f"<0x{b:02X}>" in self.score_of for b in raw)):
            return len(raw)
        return 1

    def count_word(self, word: str) -> int:
        """Tokens of one blank-marked word."""
        size = len(word)
        best, count = [0.0] * (size + 1), [0] * (size + 1)
        begin = [-1] * (size + 1)  # of the unknown run that ends here, else -1
        matches: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, match in self.automaton.iter(word):
            matches[end].append(match)
        for at in range(size):
            top, origin = None, -1
            # begins in ascending order, so that the first of equal sums stays
            for length, score in sorted(matches[at], reverse=True):
                total = score + best[at + 1 - length]
                if top is None or total > top:
                    top, origin = total, at + 1 - length
            unknown = False
            if word[at] not in self.single:
                total = self.unknown_score + best[at]
                if top is None or total > top:
                    top, origin, unknown = total, at, True
            best[at + 1] = top
            if unknown:
                start = begin[at] if begin[at] >= 0 else at
                begin[at + 1] = start
                count[at + 1] = count[start] + self._unknown_tokens(word[start : at + 1])
            else:
                count[at + 1] = count[origin] + 1
        return count[size]

    def count(self, text: str) -> int:
        """Tokens of a text: blanks become marks that begin words, and the first word gets one if it has none."""
        if not text:
            return 0
        if BLANK in text:
            text = text.replace(BLANK, " ")
        words = text.split(" ")
        if not words[0]:
            del words[0]
        try:
            return sum(map(self.memory.__getitem__, words))
        except KeyError:
            pass
        total, memory = 0, self.memory
        for word in words:
            found = memory.get(word)
            if found is None:
                found = self.count_word(BLANK + word)
                if len(word) <= 200:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[word] = found
            total += found
        return total


def piece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, as they are in it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


_loaded: dict[str, CountingUnigram] = {}


def load(path: str) -> CountingUnigram:
    if path not in _loaded:
        _loaded[path] = CountingUnigram(piece_vocabulary(path))
    return _loaded[path]


def count_tokens(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``: the unigram tokens of the whole text, by the pieces and scores of a sentencepiece file.

    Null and empty texts have 0. Every row is kept, repeated rows too; a column ``n_tokens`` of ``df`` is replaced.
    No shuffle, and no token sequence is built; memory is that of one Arrow batch and the remembered words.
    """
    frame = df.drop("n_tokens")

    def make():
        model = load(path)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(batch.schema.get_field_index(text)).to_pylist()
            counts = [model.count(t or "") for t in column]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, "n_tokens"])

        return run

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return arrow_map(frame, make, f"{kept}, n_tokens bigint")
