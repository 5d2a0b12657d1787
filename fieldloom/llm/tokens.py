"""Token counts of a unigram tokenizer without its tokens: Aho-Corasick matches and a dynamic programme of scores and counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._shared import ship_package, text_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "\u2581"
#: What a character outside the vocabulary costs beyond the lowest score.
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers, at most; then it starts anew. Longer words are worked out each time.
REMEMBERED, LONGEST = 1_000_000, 64


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece file; control and byte pieces match no text."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    odd = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not odd(i)]


class _Costs(dict):
    """Costs of words, each worked out when first looked up."""

    def __init__(self, cost):
        self.cost = cost

    def __missing__(self, word: str) -> int:
        c = self.cost(word)
        if len(word) <= LONGEST:
            self[word] = c
        return c


class Counter:
    """Pieces and score of the best segmentation of a text, under a unigram model with byte fallback.

    White space: each space, and each mark that stands for one, begins a word and belongs to it, and the text's
    beginning counts as a space. Words are segmented one by one. Ties go to the piece that begins first, as in a
    forward search that replaces a best path only by a higher score. A character that no piece of its own covers
    may be spelt in bytes, at the lowest score less a penalty, and counts one piece a byte. Scores are whole numbers
    here, so sums are exact in any order.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        split_line = not any("\n" in p for p, _ in vocabulary)
        self.breaks = "\n" if split_line else None
        self.words = _Costs(lambda w: self._cost(SPACE + w))
        self.heads = _Costs(self._cost)

    def segment(self, word: str) -> tuple[int, float]:
        """(pieces, score) of a word as it stands."""
        none, unknown, last = float("-inf"), self.unknown, len(word) - 1
        score, count, at = [0.0], [0], 0  # of the best path to each settled position; the next match ends at at + 1 or later
        best, pieces, longest, own = none, 0, 0, False
        for end, (length, s) in chain(self.machine.iter(word), ((last + 1, (0, none)),)):
            while at < end:  # matches come in order of their ends, so nothing more ends here
                if not own and score[at] + unknown > best:
                    best, pieces = score[at] + unknown, count[at] + len(word[at].encode("utf-8", "surrogatepass"))
                score.append(best)
                count.append(pieces)
                at += 1
                best, own = none, False
            if end > last:
                break
            start = end + 1 - length
            s += score[start]
            if s > best or (s == best and length > longest):
                best, pieces, longest = s, count[start] + 1, length
            if length == 1:
                own = True
        return count[-1], score[-1]

    def _cost(self, word: str) -> int:
        """Score and count in one whole number."""
        count, score = self.segment(word)
        return (int(-score) << 44) + count

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a text."""
        if not text:
            return 0, 0.0
        text = text.replace(SPACE, " ")
        if text[0] != " ":
            text = " " + text
        total, words, heads = 0, self.words, self.heads
        lines = text.split(self.breaks) if self.breaks else [text]
        for k, line in enumerate(lines):
            head, *parts = line.split(" ")
            if head:
                total += heads[head]
            total += sum(map(words.__getitem__, parts))
        total += (len(lines) - 1) * ((int(-self.unknown) << 44) + 1)
        if len(words) + len(heads) > REMEMBERED:
            words.clear()
            heads.clear()
        return total & ((1 << 44) - 1), -float(total >> 44)


_counters: dict[str, Counter] = {}


def _counted(vocabulary: list[tuple[str, float]]):
    version = hashlib.sha256(repr(vocabulary).encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(version)
        if counter is None:
            counter = _counters.setdefault(version, Counter(vocabulary))
        for rb in batches:
            got = [counter.count(t.as_py()) for t in rb.column(1)]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "n_tokens", "score"])

    return run


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens long, score double) of each row of (doc_id, text); whole texts.

    The driver reads the vocabulary and sends it along. Null and empty texts have no tokens and score 0; a null
    doc_id stays null; repeated rows count each; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    vocabulary = read_vocabulary(path)
    if any(s != int(s) for _, s in vocabulary):
        raise ValueError("scores must be whole numbers")
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(_counted(vocabulary), "doc_id long, n_tokens long, score double")
