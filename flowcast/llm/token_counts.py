"""Token counts by a count-only Viterbi over a unigram vocabulary.

Texts are cut before every space (a space becomes the mark U+2581, and a text that does
not start with one gets one in front), as a Metaspace pre-tokenizer does. In each part an
Aho-Corasick automaton enumerates all vocabulary pieces that end at a position, and
dynamic programming carries the best score and the piece count to each position, no
lattice and no strings. Ties follow the tokenizer: of equal scores the piece that starts
first, that is the longest, stays. A character that is no piece of its own can be an
unknown of the least score less 10; with byte fallback it counts its UTF-8 bytes, else
neighbouring unknowns count as one.

The vocabulary (pieces with scores) is read on the driver from a public model file named
by a parameter, whose size bounds what tasks receive. Control, unknown and byte pieces
never match text. Each Python worker remembers counts of parts it has met, up to a bound
after which it starts anew; that changes speed only.

Defined cases: null and empty texts have no token; repeated rows count each; an empty
table gives an empty table; whole texts are read; other columns never take part. A part
of any length keeps only the states that a piece can still reach back to.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.llm.common import read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 400_000
STATES_HELD = 1 << 14  # positions kept while a part is counted


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, float], ...]
    least: float  # smallest score of the whole vocabulary
    byte_fallback: bool


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    pieces = tuple((sp.id_to_piece(i), sp.get_score(i)) for i in ids
                   if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return Vocabulary(pieces, min(sp.get_score(i) for i in ids), sum(map(sp.is_byte, ids)) == 256)


class PartCounter(dict):
    """Pieces of a part (without its leading mark), remembered."""

    def __init__(self, vocabulary: Vocabulary, held: int = STATES_HELD):
        super().__init__()
        self.longest = max((len(p) for p, _ in vocabulary.pieces), default=0)
        self.held = max(held, 2 * self.longest + 2)
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.singles = {p for p, _ in vocabulary.pieces if len(p) == 1}
        self.unknown = vocabulary.least - UNKNOWN_PENALTY
        self.byte_fallback = vocabulary.byte_fallback

    def __missing__(self, part: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.count(MARK + part)
        if len(part) <= 64:
            self[part] = n
        return n

    def count(self, text: str) -> int:
        """Lists hold the states from position ``low`` on; no piece starts further back."""
        size, singles, unknown = len(text), self.singles, self.unknown
        best, start, count, unknown_end = [0.0], [0], [0], [False]
        low = at = 0

        def reach(to: int) -> None:
            nonlocal low, at
            while at < to:
                c = text[at]
                at += 1
                if c in singles:
                    best.append(float("-inf"))
                    start.append(at)
                    count.append(0)
                    unknown_end.append(False)
                else:
                    best.append(best[-1] + unknown)
                    start.append(at - 1)
                    if self.byte_fallback:
                        count.append(count[-1] + len(c.encode()))
                    else:
                        count.append(count[-1] + (not unknown_end[-1]))
                    unknown_end.append(True)
                if len(best) > self.held:
                    drop = len(best) - self.longest - 1
                    for states in (best, start, count, unknown_end):
                        del states[:drop]
                    low += drop

        if len(self.automaton):
            for last, (length, score) in self.automaton.iter(text):
                end = last + 1
                if at < end:
                    reach(end)
                begin, here = end - length, end - low
                total = best[begin - low] + score
                if total > best[here] or (total == best[here] and begin < start[here]):
                    best[here], start[here], count[here] = total, begin, count[begin - low] + 1
                    unknown_end[here] = False
        reach(size)
        return count[-1]


_COUNTERS: dict[int, PartCounter] = {}


def counter(vocabulary: Vocabulary) -> PartCounter:
    """One counter a worker process and vocabulary."""
    key = hash(vocabulary)
    if key not in _COUNTERS:
        _COUNTERS[key] = PartCounter(vocabulary)
    return _COUNTERS[key]


def count_tokens(text: str | None, parts: PartCounter) -> int:
    if not text:
        return 0
    words = text.replace(MARK, " ").split(" ") if MARK in text else text.split(" ")
    if not words[0]:
        words = words[1:]  # the text starts with a mark of its own
    return sum(map(parts.__getitem__, words))


def token_count(text: Column, vocabulary: Vocabulary) -> Column:
    def of(texts: pa.Array) -> pa.Array:
        parts = counter(vocabulary)
        return pa.array([count_tokens(t, parts) for t in texts.to_pylist()], pa.int64())
    return F.arrow_udf(of, "bigint")(text)


def query(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", token_count(F.col("text"), load_vocabulary(model)).alias("n_tokens"))
